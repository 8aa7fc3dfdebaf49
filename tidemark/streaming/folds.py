"""Threshold bars and CUSUM over streams, with keyed state and event-time timers (an extension).

A symbol's rows wait in its state until the watermark passes them, then go through the fold in their order, so what comes
out doesn't depend on how rows were dealt to micro-batches: it is what the batch operators give for the same rows. State
is the fold's few numbers and the rows within the watermark's delay. The session needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """Rows (ts in microseconds, seq, x) in order through `step`; subclasses say what is kept and what comes out."""

    kept = ""  # schema of the fold's state
    start: tuple = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.kept)
        self.waiting = handle.getListState("waiting", "ts long, seq long, x double")

    def step(self, state: tuple, x: float | None) -> tuple[tuple, tuple | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [t for part in rows for t in zip(part["us"].tolist(), part["seq"].tolist(), part["x"].tolist())]
        self.waiting.appendList(new)
        yield from self._passed(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._passed(key, timerValues)

    def _passed(self, key, timers) -> Iterator[pd.DataFrame]:
        limit = timers.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= limit]
        if len(ready) < len(rows):
            self.handle.registerTimer(rows[len(ready)][0] // 1000 + 1)
        if not ready:
            return
        state, out = tuple(self.state.get()) if self.state.exists() else self.start, []
        for us, seq, x in ready:
            state, told = self.step(state, None if x is None or x != x else x)
            if told is not None:
                out.append((key[0], pd.Timestamp(us, unit="us"), seq, *told))
        self.state.update(state)
        if len(ready) < len(rows):
            self.waiting.put(rows[len(ready) :])
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=self.names)


class ThresholdFold(Fold):
    kept, start, names = "total double", (0.0,), ["symbol", "ts", "seq", "x"]

    def __init__(self, m: float):
        self.m = m

    def step(self, state, x):
        total = state[0] + (x or 0.0)
        return ((0.0,), (x,)) if total >= self.m else ((total,), None)


class CusumFold(Fold):
    kept, start, names = "i long, last double, p double, q double", (0, float("nan"), 0.0, 0.0), ["symbol", "ts", "seq", "cusum_pos", "cusum_neg", "cusum_event"]

    def __init__(self, threshold: float, drift: float, reset: int):
        self.threshold, self.drift, self.reset = threshold / 100, drift / 100, reset

    def step(self, state, x):
        i, last, p, q = state
        r = x / last - 1 if x is not None and last == last and last else 0.0
        p, q = (max(0.0, p + r - self.drift), min(0.0, q + r + self.drift)) if i else (0.0, 0.0)
        e = 1 if p > self.threshold else -1 if q < -self.threshold else 0
        new = (0.0, 0.0) if i % self.reset == 0 else (0.0 if e == 1 else p, 0.0 if e == -1 else q)
        return (i + 1, float("nan") if x is None else x, *new), (p, q, e)


def _folded(rows: DataFrame, x: str, seq: str | None, delay: str, fold: Fold, schema: str) -> DataFrame:
    rows = rows.withWatermark("ts", delay)
    rows = rows.select("symbol", "ts", F.unix_micros("ts").alias("us"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("seq"), F.col(x).cast("double").alias("x"))
    return rows.groupBy("symbol").transformWithStateInPandas(fold, schema, "Append", "EventTime")


def stream_threshold_bars(ticks: DataFrame, x: str, m: float, delay: str = "10 minutes") -> DataFrame:
    """(symbol, ts, seq, x) of the ticks at which a running sum of x reaches m, as the watermark passes them; later ones than
    `delay` are dropped. Nulls count as zero."""
    return _folded(ticks, x, "seq", delay, ThresholdFold(m), "symbol string, ts timestamp, seq long, x double")


def stream_cusum(bars: DataFrame, threshold: float = 0.5, drift: float = 0.05, reset: int = 48, delay: str = "10 minutes") -> DataFrame:
    """(symbol, ts, seq, cusum_pos, cusum_neg, cusum_event) of each bar as the watermark passes it; seq is 0."""
    return _folded(bars, "close", None, delay, CusumFold(threshold, drift, reset), "symbol string, ts timestamp, seq long, cusum_pos double, cusum_neg double, cusum_event int")
