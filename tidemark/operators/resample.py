"""Point-in-time resampling and strict as-of context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunked import CHUNK, carried
from tidemark.operators.series import over
from tidemark.schema import minutes

OHLCV = ("open", "high", "low", "close", "volume")
SUMMED = ("volume", "vol", "amount", "turnover", "count", "trades", "ticks")


def ohlcv(df: DataFrame, minutes: int, price: str | None = None, qty: str = "qty", order: str = "seq", extra: tuple[str, ...] = (), offset: int = 0) -> DataFrame:
    """Bars closed left and labelled by their end, starting `offset` minutes late. From ticks (`price`) or from finer bars.

    Extra columns are summed if their name says that they count something, else the last one stays.
    """
    end = F.window("ts", f"{minutes} minutes", f"{minutes} minutes", f"{offset} minutes").end.alias("ts")
    o, h, lo, c, v = (price, price, price, price, qty) if price else OHLCV
    more = [F.sum(x).alias(x) if any(p in x.lower() for p in SUMMED) else F.max_by(x, order).alias(x) for x in extra]
    return df.groupBy("symbol", end).agg(
        F.min_by(o, order).alias("open"), F.max(h).alias("high"), F.min(lo).alias("low"), F.max_by(c, order).alias("close"), F.sum(v).alias("volume"), *more
    )


def with_gaps(bars: DataFrame, minutes: int) -> DataFrame:
    """The same bars with empty bins between each symbol's first and last: null prices, volume 0."""
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spine = ends.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"interval {minutes} minutes"))).alias("ts"))
    out = spine.join(bars, ["symbol", "ts"], "left")
    return out.withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def as_of(base: DataFrame, higher: DataFrame, frame: str, strict: bool = True, columns: tuple[str, ...] = OHLCV, seconds: int = CHUNK) -> DataFrame:
    """Each base row with the last higher bar that ended before it (or at it, if not strict), as {frame}_{column}.

    Both sides go through one sort by symbol, chunk of time and time; a running `last` carries the bar within a chunk,
    and a table of the chunks' last bars carries it into the next ones. The cost doesn't grow with the number of matches.
    """
    side = 1 if strict else -1  # where a base row stands among bars that end at its own time
    names = base.columns
    a = base.select("symbol", "ts", F.struct(*names).alias("_b"), F.lit(None).cast(higher.select(F.struct("ts", *columns)).schema[0].dataType).alias("_h"), F.lit(0).alias("_s"))
    b = higher.select("symbol", "ts", F.lit(None).cast(base.select(F.struct(*names)).schema[0].dataType).alias("_b"), F.struct("ts", *columns).alias("_h"), F.lit(side).alias("_s"))
    out = carried(a.unionByName(b), "_h", ["ts", "_s"], seconds).where("_b is not null")
    return out.select("_b.*", F.col("_h.ts").alias(f"{frame}_end"), *[F.col(f"_h.{c}").alias(f"{frame}_{c}") for c in columns])


def derived(df: DataFrame, frame: str) -> DataFrame:
    """Return, distance, range, position and momentum alignment against a higher frame's columns."""
    col = lambda c: F.col(f"{frame}_{c}")
    pct = lambda a, b: F.try_divide(a, b) * 100
    step = lambda c: F.signum(c - F.lag(c).over(over()))
    up, hup = step(F.col("close")), step(col("close"))
    return df.select(
        "*", ((F.try_divide(col("close"), col("open")) - 1) * 100).alias(f"{frame}_return"),
        ((F.try_divide(F.col("close"), col("close")) - 1) * 100).alias(f"distance_from_{frame}"),
        pct(col("high") - col("low"), col("close")).alias(f"{frame}_range_pct"),
        pct(F.col("close") - col("low"), F.nullif(col("high") - col("low"), F.lit(0.0))).alias(f"position_in_{frame}_range"),
        F.when((up > 0) & (hup > 0), 1).when((up < 0) & (hup < 0), -1).otherwise(0).alias(f"{frame}_momentum_align"),
    )


def higher_frames(base: int) -> list[str]:
    """Higher time frames worth attaching to bars of `base` minutes."""
    return ["30min", "4H", "1D"] if base < 30 else ["4H", "1D"] if base < 240 else ["1D", "1W"] if base < 1440 else ["1W"]


def join_features(df: DataFrame, features: DataFrame) -> DataFrame:
    """Features beside the rows of the same symbol and time."""
    return df.join(features, ["symbol", "ts"], "left")


def process(ticks: DataFrame, base: int, frames: tuple[str, ...] = ("30min", "4H", "1D"), price: str = "price", gaps: bool = False) -> DataFrame:
    """Base bars of `base` minutes with `t` (epoch milliseconds) and each higher frame's context and derived columns.

    gaps: bins without ticks are bars too, with null prices, as they then are in the context.
    """
    make = lambda m: with_gaps(ohlcv(ticks, m, price), m) if gaps else ohlcv(ticks, m, price)
    df = make(base)
    for f in frames:
        df = as_of(df, make(minutes(f)), f)
    for f in frames:
        df = derived(df, f)
    return df.withColumn("t", F.unix_millis("ts"))
