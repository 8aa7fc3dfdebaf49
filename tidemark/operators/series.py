"""Ordered-series building blocks: windows, lags, affine recurrences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = ["symbol"], ["ts"]


def over(key: list[str] | None = None, order: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*(key or KEY)).orderBy(*(order or ORDER))


def last(n: int, skip: int = 0) -> WindowSpec:
    """The last n rows, ending `skip` rows before the current one."""
    return over().rowsBetween(-(n - 1) - skip, -skip)


def full(agg: Column, c: Column, n: int, skip: int = 0) -> Column:
    """An aggregate over the last n rows; null until there are n values."""
    w = last(n, skip)
    return F.when(F.count(c).over(w) == n, agg.over(w))


def change(c: Column, k: int = 1) -> Column:
    return F.try_divide(c, F.lag(c, k).over(over())) - 1


def zscore(c: Column, n: int) -> Column:
    return F.try_divide(c - full(F.avg(c), c, n), F.nullif(full(F.stddev_samp(c), c, n), F.lit(0.0)))


def smooth(df: DataFrame, x: str, alpha: float, out: str, key: list[str] | None = None, order: list[str] | None = None, start: str | None = None) -> DataFrame:
    """y = alpha * x + (1 - alpha) * y before it, from y = x at the first row, by windows alone.

    Rows are cut into blocks so long that (1 - alpha) ** length is about 1e-12. Within a block y is
    one running sum of scaled values; of earlier blocks the ends of the last two carry in, the rest
    is below double precision. `start` names a boolean column: rows before its first true have no y
    and the first true row starts it.
    """
    key, order = key or KEY, order or ORDER
    decay = 1 - alpha
    size = max(2, int(27 / -math.log(decay)))
    w = Window.partitionBy(*key).orderBy(*order)
    began = F.coalesce(F.col(start), F.lit(False)) if start else F.col(x).isNotNull()
    df = df.withColumn("_on", F.max(began).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_rn", F.sum(F.col("_on").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    df = df.withColumn("_blk", F.when(F.col("_on"), F.floor(F.col("_rn") / size)).otherwise(F.lit(-1)))
    df = df.withColumn("_k", (F.col("_rn") % size).cast("double"))
    term = F.when(F.col("_rn") == 0, F.col(x)).otherwise(F.col(x) * alpha)
    inside = Window.partitionBy(*key, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = F.pow(F.lit(decay), F.col("_k")) * F.sum(term * F.pow(F.lit(decay), -F.col("_k"))).over(inside)
    df = df.withColumn("_loc", F.when(F.col("_on"), local))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("_k") == size - 1
    df = df.withColumn("_e", F.when(ends, F.col("_loc") + decay**size * F.coalesce(F.last(F.when(ends, F.col("_loc")), True).over(past), F.lit(0.0))))
    y = F.col("_loc") + F.pow(F.lit(decay), F.col("_k") + 1) * F.coalesce(F.last("_e", True).over(past), F.lit(0.0))
    return df.withColumn(out, y).drop("_on", "_rn", "_blk", "_k", "_loc", "_e")


def ema(df: DataFrame, n: int, out: str | None = None, x: str = "close") -> DataFrame:
    """Exponential mean over n, null until there are n rows."""
    out = out or f"ema_{n}"
    df = smooth(df, x, 2 / (n + 1), "_y")
    seen = F.count(x).over(over().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(seen >= n, F.col("_y"))).drop("_y")
