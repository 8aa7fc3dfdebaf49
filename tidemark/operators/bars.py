"""Sampling of ticks into bars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.chunked import BLOCK, placed
from tidemark.operators.quantiles import quantiles
from tidemark.operators.series import over
from tidemark.storage import store

BY = ["ts", "seq"]


def mad_outliers(ticks: DataFrame, x: str = "price", limit: float = 3.0) -> DataFrame:
    """Rows with `outlier`: 0.6745 * |x - median| over the median of such distances above `limit`, per symbol."""
    mid = quantiles(ticks, ["symbol"], x, [0.5], "_mid")
    far = store(ticks.join(mid, "symbol", "left").withColumn("_far", F.abs(F.col(x) - F.col("_mid")[0])))
    mad = quantiles(far, ["symbol"], "_far", [0.5], "_mad")
    score = F.try_divide(F.lit(0.6745) * F.col("_far"), F.col("_mad")[0])
    return far.join(mad, "symbol", "left").withColumn("outlier", F.coalesce(score > limit, F.lit(False))).drop("_mid", "_far", "_mad")


def log_returns(ticks: DataFrame, x: str = "price") -> DataFrame:
    """Differences of logarithms; rows without a value in this row or the one before are left out. The logarithm of zero is
    minus infinity and that of a negative value NaN, and such rows stay."""
    v = F.col(x)
    log = F.when(v < 0, F.lit(float("nan"))).when(v == 0, F.lit(float("-inf"))).otherwise(F.ln(v))
    return ticks.withColumn("log_return", log - F.lag(log).over(over(order=BY))).where("log_return is not null")


def tick_bars(ticks: DataFrame, m: int) -> DataFrame:
    """Every m-th row."""
    return ticks.withColumn("_rn", F.row_number().over(over(order=BY))).where(F.col("_rn") % m == 0).drop("_rn")


def _sums(v: np.ndarray, signed: bool) -> np.ndarray:
    v = np.nan_to_num(v.astype(float), nan=0.0)
    if not signed and (v < 0).any():
        raise ValueError("threshold bars need values that are not negative")
    return np.cumsum(v)


def _next(s: np.ndarray, m: float) -> np.ndarray:
    """For each row the first later row at which a sum that starts behind it reaches m; len(s) if there is none."""
    if (np.diff(s) >= 0).all():
        return np.maximum(np.searchsorted(s, s + m), np.arange(1, len(s) + 1))
    tops = [np.append(s, -np.inf)]  # the largest sum of each run of 2 ** i rows; behind the last row there is none
    while 2 ** len(tops) <= len(s):
        t, half = tops[-1], 2 ** (len(tops) - 1)
        tops.append(np.maximum(t, t[np.minimum(np.arange(len(t)) + half, len(s))]))
    at = np.arange(1, len(s) + 1)
    for i in reversed(range(len(tops))):  # runs below the mark are passed, the longest first
        at = np.where(tops[i][at] < s + m, np.minimum(at + 2**i, len(s)), at)
    return at


def _heads(m: float, signed: bool):
    """What a block does to any sum carried into it: rows (reach, need), one for each row that may be its first to emit. A
    sum that lacks up to `reach` emits there, and follows the block's pointers to their end; then it lacks `need`.
    Rows that follow each other and lead to the same end are one."""

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        s = _sums(b.sort_values("_rn")["_v"].to_numpy(), signed)
        ends = np.append(_next(s, m), len(s))
        at = np.arange(len(s) + 1)
        ends = np.where(ends == len(s), at, ends)  # pointers stop at the last row that can emit
        while not np.array_equal(far := ends[ends], ends):
            ends = far
        peak = np.maximum.accumulate(s)
        before = np.append(-np.inf, peak[:-1])
        first = np.flatnonzero((s > before) if signed else (before < m))  # a sum with negative values may lack more than m
        end = ends[first]
        last = np.flatnonzero(np.append(end[1:] != end[:-1], True))
        first, end = first[last], end[last]
        need = m - (s[-1] - s[end])
        return pd.DataFrame({"symbol": key[0], "_b": key[1], "reach": [s[first].tolist()], "need": [need.tolist()], "total": s[-1]})

    return run


def _entries(m: float):
    """What a symbol's running sum lacks at the start of each block, block after block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, lacks = None, m
        for b in batches:
            out = []
            for s, reach, need, total in zip(b["symbol"], b["reach"], b["need"], b["total"]):
                if s != symbol:
                    symbol, lacks = s, m
                out.append(lacks)
                lacks = need[np.searchsorted(reach, lacks)] if lacks <= reach[-1] else lacks - total
            yield pd.DataFrame({"symbol": b["symbol"], "_b": b["_b"], "_lacks": out})

    return run


def _marked(m: float, columns: list[str], signed: bool):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_rn")
        s = _sums(b["_v"].to_numpy(), signed)
        nexts, at, take = _next(s, m), int(np.searchsorted(np.maximum.accumulate(s), b["_lacks"].iloc[0])), []
        while at < len(s):
            take.append(at)
            at = int(nexts[at])
        return b.iloc[take][columns]

    return run


def threshold_bars(ticks: DataFrame, x: str, m: float, size: int = BLOCK, signed: bool = False) -> DataFrame:
    """The rows at which a running sum of x reaches m; the sum then starts again at zero, its overshoot discarded.

    Blocks of `size` rows of a symbol are worked on side by side. In a block, each row points at the row that would emit next
    after it, found in the running sums, and doubling the pointers leads each row to the block's last emission on its way. A block
    so becomes a short table from what a sum lacks when it enters to what it lacks when it leaves; only these tables pass in
    order, a few rows for each block, and then every block marks its own rows.

    x must not be negative unless `signed`: then a sum may fall below zero and has to come back, and a block's table has a row for each
    new peak of its sums that leads to another end. Null counts as zero. Sums are differences of running sums, so a sum that meets m to within
    rounding may be told one row off what a plain loop of doubles says; whole numbers are exact. m of zero or less takes every row.
    """
    if m <= 0 and not signed:
        return ticks
    names = ticks.columns
    rows = placed(ticks, tuple(BY)).withColumn("_v", F.coalesce(F.col(x).cast("double"), F.lit(0.0))).withColumn("_b", F.expr(f"(_rn - 1) div {size}"))
    kind = rows.schema["symbol"].dataType.simpleString()
    heads = rows.select("symbol", "_b", "_rn", "_v").groupBy("symbol", "_b").applyInPandas(_heads(m, signed), f"symbol {kind}, _b long, reach array<double>, need array<double>, total double")
    entries = heads.repartition("symbol").sortWithinPartitions("symbol", "_b").mapInPandas(_entries(m), f"symbol {kind}, _b long, _lacks double")
    return rows.join(entries, ["symbol", "_b"]).groupBy("symbol", "_b").applyInPandas(_marked(m, names, signed), ticks.schema)


def form_dollar_bars(ticks: DataFrame, m: float, x: str = "value", path: str | None = None) -> DataFrame:
    """Bars of m by value, without those that have a null in any column; written to `path` as CSV if one is given. Values of
    either sign count, as prices may be negative."""
    bars = threshold_bars(ticks, x, m, signed=True).na.drop()
    if path:
        bars.write.csv(path, header=True)
    return bars


def time_bars(ticks: DataFrame, minutes: int, fill: bool = True) -> DataFrame:
    """Bars labelled by their start: open, high, low, close and volume of the ticks first seen at each time.

    Empty bins between a symbol's first and last bar carry the last prices and volume 0.
    """
    first = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("seq"))
    ticks = ticks.withColumn("_n", first).where("_n = 1")
    at = F.window("ts", f"{minutes} minutes").start
    bars = ticks.groupBy("symbol", at.alias("ts")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("qty").alias("volume")
    )
    if not fill:
        return bars
    spine = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spine = spine.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"interval {minutes} minutes"))).alias("ts"))
    w = over().rowsBetween(Window.unboundedPreceding, 0)
    bars = spine.join(bars, ["symbol", "ts"], "left")
    return bars.select("symbol", "ts", *[F.last(c, True).over(w).alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))
