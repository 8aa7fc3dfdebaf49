"""Long series cut into chunks of time and blocks of rows, so that one symbol's history fills many tasks.

Rows only ever move by (symbol, chunk of time) or (symbol, block of rows). What has to cross a border is either
copied as a halo (the rows a bounded frame looks back on) or carried by a table with one row for each symbol
and chunk (counts, totals, last values), which alone is ordered by symbol. That table is made from the rows and joined back
to them, so the rows are stored first: operators that follow each other would otherwise double their plan each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import store

CHUNK, BLOCK = 7 * 86400, 65_536  # seconds, rows


def chunk_of(ts: str = "ts", seconds: int = CHUNK) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def before(parts: DataFrame, key: list[str], chunk: str, value: str, out: str) -> DataFrame:
    """(key, chunk, out): the sum of `value` over a key's earlier chunks. parts: one row a key and chunk."""
    w = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*key, chunk, F.coalesce(F.sum(value).over(w), F.lit(0)).alias(out))


def running_total(df: DataFrame, value: Column, key: list[str], order: list[str], chunk: Column, out: str) -> DataFrame:
    """The sum of `value` (whole numbers) over a key's rows up to each row, in chunks that follow the order."""
    df = df.withColumn("_c", chunk).withColumn("_x", value)
    parts = before(df.groupBy(*key, "_c").agg(F.sum("_x").alias("_s")), key, "_c", "_s", "_before")
    w = Window.partitionBy(*key, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(parts, [*key, "_c"]).withColumn(out, F.sum("_x").over(w) + F.col("_before")).drop("_c", "_x", "_before")


def placed(df: DataFrame, order: tuple[str, ...] = ("ts",), seconds: int = CHUNK) -> DataFrame:
    """Rows with `_rn`, their 1-based place in their symbol's order."""
    df = store(df).withColumn("_c", chunk_of(order[0], seconds))
    parts = before(df.groupBy("symbol", "_c").agg(F.count("*").alias("_s")), ["symbol"], "_c", "_s", "_before")
    w = Window.partitionBy("symbol", "_c").orderBy(*order)
    return df.join(parts, ["symbol", "_c"]).withColumn("_rn", F.row_number().over(w) + F.col("_before")).drop("_c", "_before")


def in_blocks(df: DataFrame, f: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, size: int = BLOCK, seconds: int = CHUNK) -> DataFrame:
    """f(df), where f's columns need no more than `back` rows before a row and `ahead` after it.

    Each block of `size` rows of a symbol is computed by itself, with copies of the rows around it. Within f, `symbol` names
    symbol and block, and `_rn` the place in the symbol. Inside another call f is simply applied.
    """
    if "_halo" in df.columns:
        return f(df)
    size = max(size, back, ahead)
    kind = df.schema["symbol"].dataType
    names = [c for c in df.columns if c != "symbol"]
    own = F.expr(f"(_rn - 1) div {size}")
    at = F.expr(f"(_rn - 1) % {size}")
    all_ = F.array_compact(F.array(own, F.when(at >= size - back, own + 1), F.when(at < ahead, own - 1)))
    df = placed(df, seconds=seconds).withColumn("_own", own).withColumn("_blk", F.explode(all_))
    df = df.select(F.struct(F.col("symbol").alias("s"), F.col("_blk").alias("b")).alias("symbol"), *names, "_rn", (F.col("_blk") != F.col("_own")).alias("_halo"))
    out = f(df).where(~F.col("_halo")).drop("_halo", "_rn")
    return out.withColumn("symbol", F.col("symbol.s").cast(kind))


def carried(rows: DataFrame, value: str, order: list[str], seconds: int = CHUNK) -> DataFrame:
    """rows (symbol, ts, ...) with `value` replaced by its last non-null at or before each row, in the given order."""
    rows = store(rows).withColumn("_c", chunk_of("ts", seconds))
    place = F.struct(*order)
    tails = rows.groupBy("symbol", "_c").agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_t"))
    past = Window.partitionBy("symbol").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select("symbol", "_c", F.last("_t", True).over(past).alias("_past"))
    w = Window.partitionBy("symbol", "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(tails, ["symbol", "_c"]).withColumn(value, F.coalesce(F.last(value, True).over(w), F.col("_past"))).drop("_c", "_past")
