"""Indicators of higher time frames carried by base bars, and the complete data set.

Base rows carry a higher frame's last finished bar as `{frame}_open` ... `{frame}_volume` and its end
as `{frame}_end`. Its indicators are computed on one row a bar and come back to the base rows by a
non-strict as-of join: the last bar's row, as it is, at or before the base row.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import events as E
from tidemark.operators import indicators as I
from tidemark.operators import resample as R
from tidemark.operators.series import change, ema, over

PARTS = R.OHLCV


def bars_of(df: DataFrame, frame: str, whole: bool = True, on: str = "end") -> DataFrame:
    """The higher frame's bars as (symbol, ts, open ... volume), one row a bar; whole: only bars without nulls.

    `on` says what tells bars apart: their end, or their close, which merges neighbours of equal close.
    """
    cols = [f"{frame}_{c}" for c in PARTS]
    df = I.new_bars(df.na.drop(subset=cols) if whole else df, frame, on)
    return df.select("symbol", "ts", *[F.col(c).alias(p) for c, p in zip(cols, PARTS)])


def periods_of(frame: str, cfg: dict[str, Any]) -> dict[str, int]:
    m = schema.minutes(frame)
    return cfg["periods"]["daily" if m >= 1440 else "hourly" if m >= 60 else "intraday"]


def _tail(x: Column, k: Column, most: int, stat) -> Column:
    """A statistic of the last k rows (k <= most, a column); null unless all k are values."""
    w = over().rowsBetween(-(most - 1), 0)
    held = F.collect_list(F.coalesce(x.cast("double"), F.lit(float("nan")))).over(w)
    part = F.slice(held, F.greatest(F.size(held) - k + 1, F.lit(1)), k)
    whole = (k > 0) & (F.size(held) >= k) & ~F.exists(part, F.isnan)
    return F.when(whole, stat(part))


def _sum(a: Column, f=lambda v: v) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v))


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def _deviation(a: Column) -> Column:
    mean = _mean(a)
    return F.when(F.size(a) > 1, F.sqrt(F.aggregate(F.transform(a, lambda v: F.pow(v - mean, 2)), F.lit(0.0), lambda acc, v: acc + v) / (F.size(a) - 1)))


def frame_indicators(bars: DataFrame, frame: str, cfg: dict[str, Any] | None = None, least: int = 20) -> DataFrame:
    """(symbol, ts, {frame}_ema_*, rsi, returns, momentum_*, volatility, volume_sma) of a frame's bars.

    Volatility and volume mean run over min(20, half a symbol's bars). Symbols with fewer than
    `least` bars have nulls.
    """
    periods = periods_of(frame, schema.config(cfg))
    df = bars.withColumn("_n", F.count("*").over(Window.partitionBy("symbol")))
    for name, n in periods.items():
        df = ema(df, n, f"ema_{name}")
    df = I.rsi(df, 14).withColumn("returns", change(F.col("close")))
    df = df.withColumn("momentum_short", change(F.col("close"), periods["short"])).withColumn("momentum_medium", change(F.col("close"), periods["medium"]))
    k = F.least(F.lit(20), F.expr("_n div 2")).cast("int")
    df = df.withColumn("volatility", _tail(F.col("returns"), k, 20, _deviation)).withColumn("volume_sma", _tail(F.col("volume"), k, 20, _mean))
    names = [*[f"ema_{x}" for x in periods], "rsi", "returns", "momentum_short", "momentum_medium", "volatility", "volume_sma"]
    return df.select("symbol", "ts", *[F.when(F.col("_n") >= least, F.col(c)).alias(f"{frame}_{c}") for c in names])


def align(df: DataFrame, values: DataFrame) -> DataFrame:
    """Base rows with the last row of `values` at or before them."""
    names = [c for c in values.columns if c not in ("symbol", "ts")]
    out = R.as_of(df, values, "_v", strict=False, columns=tuple(names))
    return out.select(*df.columns, *[F.col(f"_v_{c}").alias(c) for c in names])


def higher_context(df: DataFrame, low: str | None = None, cfg: dict[str, Any] | None = None) -> DataFrame:
    """Base rows with the indicators of each higher frame they carry, and how the base relates to it; `low` is left out."""
    for frame in schema.frames_of(df.columns):
        if frame != low:
            df = I.cross_frame(align(df, frame_indicators(bars_of(df, frame), frame, cfg)), frame)
    return df


def base_indicators(df: DataFrame, low: str | None = None, cfg: dict[str, Any] | None = None, least: int = 20) -> DataFrame:
    """Standard indicators of the low frame's bars (of the rows themselves without `low`), carried to the base rows.

    Symbols with fewer than `least` bars have nulls.
    """
    c = schema.config(cfg)
    b = bars_of(df, low, whole=False) if low else df.select("symbol", "ts", *PARTS)
    for n in c["ema"]:
        b = ema(b, n)
    b = I.atr(I.rsi(I.macd(I.sma(b, *c["sma"]), *c["macd"]), c["rsi"]), c["atr"])
    b = I.volume_ratio(I.bollinger(b, c["bollinger"]["n"], c["bollinger"]["k"]), None)
    names = [x for x in b.columns if x not in ("symbol", "ts", *PARTS)]
    b = b.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).select("symbol", "ts", *[F.when(F.col("_n") >= least, F.col(x)).alias(x) for x in names])
    return align(df, b)


def normalized(df: DataFrame, minutes: int, low: str | None = None) -> DataFrame:
    """Realised volatility and the distances and ratios of the indicators, by the low frame's close if there is one."""
    if not low:
        return I.derived(I.realized_vol(df, minutes))
    own = df.columns
    swap = df.select(*own, F.col("close").alias("_close")).withColumn("close", F.col(f"{low}_close"))
    return I.derived(I.realized_vol(swap, minutes)).withColumn("close", F.col("_close")).drop("_close")


def complete(df: DataFrame, minutes: int, low: str | None = None, cfg: dict[str, Any] | None = None) -> DataFrame:
    """The whole data set: indicators, CUSUM, band events, normalised indicators, higher frames, statistics,
    events, co-events and confluence of base bars that carry their higher frames."""
    schema.validate(df.columns, low)
    c = schema.config(cfg)
    df = normalized(base_indicators(df, low, cfg), schema.minutes(low) if low else minutes, low)
    df = higher_context(df, low, cfg)
    bands = {"lookback": c["bb_events"]["lookback"], "least": c["bb_events"]["min_distance"]}
    df = E.all_events(df, c["events"], c["cusum"], bands)
    df = E.covents(df, list(schema.EVENTS), c["covents"]["window"], c["covents"]["max"], schema.PAIRS, schema.TRIPLES)
    return E.enhanced_type(E.confluence(df))
