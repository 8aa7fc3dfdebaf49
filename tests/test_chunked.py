"""Chunks and blocks give what whole symbols give, and spread one symbol over tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import chunked as C
from tidemark.operators import events as E
from tidemark.operators import indicators as I
from tidemark.operators import resample as R
from tidemark.operators.series import full, over

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def walk(spark):
    """Three symbols of unlike length with gaps, null closes and equal neighbours."""
    r, rows = random.Random(4), []
    for s, n in (("A", 700), ("B", 130), ("C", 1)):
        t, p = 0, 100.0
        for _ in range(n):
            t += r.choice([1, 1, 1, 2, 400])
            p = max(1.0, round(p + r.choice([-0.5, 0.0, 0.25, 0.5]), 2))
            rows.append((s, T0 + dt.timedelta(minutes=t), p, p + 1, p - 1, None if r.random() < 0.02 else p, float(r.randrange(1, 9)), 1.0 + r.random(), r.random()))
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, atr_pct double, vol_realized double"
    return spark.createDataFrame(rows, schema).cache()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    key = lambda r: (r["symbol"], r["ts"])
    x, y = (sorted((r.asDict() for r in d.select(*cols).collect()), key=key) for d in (a, b))
    assert x == y


def test_places_and_totals(walk):
    got = C.placed(walk, seconds=3600)
    want = walk.withColumn("_rn", F.row_number().over(over()).cast("long"))
    same(got.withColumn("_rn", F.col("_rn").cast("long")), want)
    total = C.running_total(walk, F.col("volume").cast("int"), ["symbol"], ["ts"], C.chunk_of("ts", 3600), "t")
    same(total.withColumn("t", F.col("t").cast("long")), walk.withColumn("t", F.sum(F.col("volume").cast("int")).over(over().rowsBetween(-(10**6), 0)).cast("long")))


@pytest.mark.parametrize("size", [7, 30, 10_000])
def test_in_blocks(walk, size):
    f = lambda d: d.select("*", full(F.avg("close"), F.col("close"), 5).alias("m"), F.lag("close", 6).over(over()).alias("g"), F.lead("close", 2).over(over()).alias("n"))
    same(C.in_blocks(walk, f, 6, 2, size=size, seconds=7200), f(walk))


def test_operators_in_small_blocks(walk, monkeypatch):
    """Every blocked operator, in blocks hardly longer than its look-back, equals itself on whole symbols."""
    makers = {
        "sma": lambda d: I.sma(d, 5, 20), "bollinger": I.bollinger, "returns": lambda d: I.returns(d, 1, 16), "vol": lambda d: I.realized_vol(d.drop("vol_realized"), 30),
        "bands": lambda d: E.band_events(I.bollinger(d)), "statistics": E.statistics, "events": lambda d: E.all_events(I.bollinger(d)),
    }
    whole = lambda d, f, back, ahead=0: f(d) if "_rn" in d.columns else f(d.withColumn("_rn", F.row_number().over(over()).cast("long"))).drop("_rn")
    for name, make in makers.items():
        small = C.in_blocks
        for m in (I, E):
            monkeypatch.setattr(m, "in_blocks", lambda d, f, back, ahead=0: small(d, f, back, ahead, size=back, seconds=86400))
        got = make(walk).cache()
        got.count()
        for m in (I, E):
            monkeypatch.setattr(m, "in_blocks", whole)
        same(got, make(walk))


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_in_chunks(walk, strict):
    higher = walk.where("volume > 6").withColumn("ts", F.expr("ts + interval 1 minute")).select("symbol", "ts", *R.OHLCV)
    small = R.as_of(walk, higher, "H", strict, seconds=600)
    rows = {(s, i): sorted((r.ts, r.close) for r in higher.collect() if r.symbol == s) for i, s in enumerate("ABC")}
    by = {s: v for (s, _), v in rows.items()}
    for r in small.collect():
        past = [x for x in by[r.symbol] if x[0] < r.ts or (not strict and x[0] == r.ts)]
        assert (r.H_end, r.H_close) == (past[-1] if past else (None, None))


def _folded(values, m):
    total, out = 0.0, []
    for i, v in enumerate(values):
        total += v or 0.0
        if total >= m:
            out.append(i)
            total = 0.0
    return out


@pytest.mark.parametrize("seed", range(4))
def test_threshold_bars_in_blocks(spark, seed):
    """Bars inside a block, over several blocks and none at all; zeros, nulls and single values above the threshold."""
    r, rows, want = random.Random(seed), [], []
    for s, n, most in (("A", 400, 5), ("B", 90, 40), ("C", 3, 2), ("D", 120, 1)):
        values = [r.choice([0, None, r.randrange(most + 1)]) if r.random() < 0.5 else r.randrange(most + 1) for _ in range(n)]
        rows += [(s, T0 + dt.timedelta(seconds=i // 3), i, None if v is None else float(v), i) for i, v in enumerate(values)]
        want += [(s, i) for i in _folded(values, 23)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, qty double, extra int")
    for size in (8, 50, 10_000):
        got = B.threshold_bars(ticks, "qty", 23, size)
        assert got.columns == ticks.columns and sorted((x.symbol, x.seq) for x in got.collect()) == sorted(want)
    assert B.threshold_bars(ticks, "qty", 0).count() == len(rows) and B.threshold_bars(ticks.limit(0), "qty", 5).count() == 0
    with pytest.raises(Exception, match="not negative"):
        B.threshold_bars(ticks.withColumn("qty", -F.col("qty")), "qty", 23).collect()


@pytest.mark.parametrize("seed", range(2))
def test_signed_threshold_bars_in_blocks(spark, seed):
    """Sums that fall below zero, over whole blocks too, and come back; thresholds of both signs."""
    r, rows = random.Random(seed), []
    for s, n, drift in (("A", 300, 1), ("B", 120, 0), ("C", 3, -1), ("D", 300, 0)):
        values = [None if r.random() < 0.05 else r.randrange(-9, 10) + drift + (-6 if s == "D" and 60 <= i < 140 else 4 if s == "D" else 0) for i in range(n)]
        rows += [(s, T0 + dt.timedelta(seconds=i // 3), i, None if v is None else float(v)) for i, v in enumerate(values)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, value double")
    for m, size in ((23, 8), (23, 50), (23, 10_000), (-4, 8)):
        want = [(s, i) for s in "ABCD" for i in _folded([v for k, _, _, v in rows if k == s], m)]
        assert sorted((x.symbol, x.seq) for x in B.threshold_bars(ticks, "value", m, size, signed=True).collect()) == want
    assert sorted((x.symbol, x.seq) for x in B.form_dollar_bars(ticks, 23).collect()) == [(s, i) for s in "ABCD" for i in _folded([v for k, _, _, v in rows if k == s], 23) if (s, i) not in {(k, j) for k, _, j, v in rows if v is None}]


def test_one_symbol_fills_many_tasks(spark):
    """A single symbol's rows are worked on in several partitions, for bars, blocks and the as-of join."""
    one = spark.range(200_000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 7).cast("double").alias("close"))
    with_part = lambda d: d.withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bars = B.threshold_bars(one, "close", 100, size=5000)
        assert bars.select("seq").count() == len(_folded([i % 7 for i in range(200_000)], 100))
        assert with_part(bars).select("p").distinct().count() > 1
        assert with_part(C.in_blocks(one, lambda d: d.withColumn("m", F.avg("close").over(over().rowsBetween(-9, 0))), 10, size=5000)).select("p").distinct().count() > 1
        higher = one.where("seq % 30 = 0").select("symbol", "ts", "close")
        assert with_part(R.as_of(one, higher, "H", columns=("close",))).select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_form_dollar_bars(spark, tmp_path):
    ticks = spark.createDataFrame([("A", T0 + dt.timedelta(seconds=i), i, 10.0, 1.0 if i % 2 else None) for i in range(20)], "symbol string, ts timestamp, seq long, value double, x double")
    bars = B.form_dollar_bars(ticks, 25.0, path=str(tmp_path / "bars"))
    assert sorted(r.seq for r in bars.collect()) == [5, 11, 17] and spark.read.csv(str(tmp_path / "bars"), header=True).count() == 3
