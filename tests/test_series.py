import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import bars, causal, events, indicators, labeling, models, resample, scoring
from tidemark.operators.series import ema, smooth

T0 = dt.datetime(2024, 1, 1)


def at(i, minutes=5):
    return T0 + dt.timedelta(minutes=minutes * i)


def ohlc(spark, closes, highs=None, lows=None, minutes=5, volume=1.0):
    rows = [("A", at(i, minutes), float(c), float(highs[i] if highs else c), float(lows[i] if lows else c), float(c), volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def test_overshoot_is_discarded(spark):
    t = spark.createDataFrame([("A", at(i), i, 1.0, 3.0) for i in range(1, 6)], "symbol string, ts timestamp, seq long, price double, qty double")
    assert [r.seq for r in bars.threshold_bars(t, "qty", 5).collect()] == [2, 4]


def test_log_returns_of_values_without_logarithm(spark):
    t = spark.createDataFrame([("A", at(i), i, p) for i, p in enumerate([1.0, 2.0, -1.0, 3.0, 0.0, 4.0, None, 5.0, 10.0])], "symbol string, ts timestamp, seq long, price double")
    got = {r.seq: r.log_return for r in bars.log_returns(t).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 8] and math.isnan(got[2]) and math.isnan(got[3])
    assert [got[1], got[8]] == pytest.approx([math.log(2)] * 2) and got[4] == -math.inf and got[5] == math.inf


def test_time_bars_sql_keeps_the_first_tick_of_a_time(spark, tmp_path):
    """The query and its SQL on events of which several of a symbol share a time."""
    import duckdb

    from tidemark.plans import queries as q

    rows = [(i, T0 + dt.timedelta(minutes=7 * (i // 3)), 8 * (i % 2), float(i * 37 % 90)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(q.SQL["b8_time_bars"]).fetchall())
    assert sorted(map(tuple, q.QUERIES["b8_time_bars"](spark, str(tmp_path)).collect())) == want and len(want) > 1


def test_as_of_is_strict(spark):
    base = ohlc(spark, [1, 2, 3])
    high = spark.createDataFrame([("A", at(1), 9.0, 9.0, 9.0, 9.0, 1.0)], base.schema)
    got = {r.ts: r["H_close"] for r in resample.as_of(base, high, "H").collect()}
    assert got == {at(0): None, at(1): None, at(2): 9.0}
    loose = {r.ts: r["H_close"] for r in resample.as_of(base, high, "H", strict=False).collect()}
    assert loose == {at(0): None, at(1): 9.0, at(2): 9.0}


def test_gaps(spark):
    b = ohlc(spark, [1, 2, 3]).where(F.col("close") != 2)
    rows = sorted(resample.with_gaps(b, 5).collect(), key=lambda r: r.ts)
    assert [(r.close, r.volume) for r in rows] == [(1.0, 1.0), (None, 0.0), (3.0, 1.0)]


def test_smooth_equals_the_recurrence(spark):
    x = [math.sin(i) * 10 + i for i in range(1500)]
    got = [r.y for r in smooth(ohlc(spark, x), "close", 2 / 13, "y").orderBy("ts").collect()]
    y, want = x[0], []
    for i, v in enumerate(x):
        y = v if i == 0 else 2 / 13 * v + (1 - 2 / 13) * y
        want.append(y)
    assert got == pytest.approx(want, abs=1e-8)


def test_ema_needs_n_rows(spark):
    got = [r.ema_12 for r in ema(ohlc(spark, range(1, 15)), 12).orderBy("ts").collect()]
    assert got[:11] == [None] * 11 and got[11] is not None


def test_cusum_segments(spark):
    x = [100 * math.exp(0.004 * math.sin(i * 1.7) + 0.0004 * i) for i in range(300)]
    got = events.cusum(ohlc(spark, x), 0.5, 0.05, 48).orderBy("ts").collect()
    p = q = 0.0
    for i, r in enumerate(got):
        step = x[i] / x[i - 1] - 1 if i else 0.0
        p, q = (max(0.0, p + step - 0.0005), min(0.0, q + step + 0.0005)) if i else (0.0, 0.0)
        e = 1 if p > 0.005 else -1 if q < -0.005 else 0
        assert (r.cusum_pos, r.cusum_neg, r.cusum_event) == (pytest.approx(p, abs=1e-12), pytest.approx(q, abs=1e-12), e)
        p, q = (0.0 if e == 1 else p), (0.0 if e == -1 else q)
        if i % 48 == 0:
            p = q = 0.0


def test_flat_prices_raise_nothing(spark):
    df = events.stat_events(events.statistics(indicators.realized_vol(indicators.atr(ohlc(spark, [5.0] * 130)), 5)))
    assert df.where("vpd_event or outlier_event or momentum_event").count() == 0


def test_window_covent_edges(spark):
    df = ohlc(spark, range(1, 6)).withColumn("a", F.col("close") == 1).withColumn("b", F.col("close") == 3)
    for w, n in ((0, 0), (1, 1), (2, 3)):
        assert df.select(events.together(["a", "b"], w).alias("x")).where("x").count() == n
    assert df.select(events.together(["a", "b"], 2, causal=True).alias("x")).where("x").count() == 1


def _label(spark, highs, lows, closes, **kw):
    b = ohlc(spark, closes, highs, lows, minutes=60)
    e = spark.createDataFrame([("x_label", "A", at(0), float(closes[0]), 0.1, 0.1, at(kw.pop("hours", 3), 60))], "label_name string, symbol string, ts timestamp, close double, profit_take double, stop_loss double, vertical timestamp")
    return labeling.triple_barrier(e, b, **kw).first()


def test_triple_barrier(spark):
    r = _label(spark, [100, 120, 100], [100, 80, 100], [100, 100, 100])
    assert (r.label, r.barrier, r.ret, r.holding_hours) == (1, "profit", 0.1, 1.0)  # a tie is a profit
    r = _label(spark, [100, 101, 102], [100, 85, 100], [100, 100, 100])
    assert (r.label, r.barrier, r.ret) == (-1, "stop", -0.1)
    r = _label(spark, [115, 101, 101], [100, 99, 99], [100, 100, 101])
    assert (r.label, r.holding_hours) == (1, 0.0)
    r = _label(spark, [115, 101, 101], [100, 99, 99], [100, 100, 101], skip_event_bar=True)
    assert (r.label, r.barrier) == (0, "vertical")
    r = _label(spark, [100, 101, 101], [100, 99, 99], [100, 100, 101], hours=0)
    assert (r.label, r.ret, r.holding_hours) == (0, 0.0, 0.0)


def test_cost_floor():
    assert labeling.cost_floor() == pytest.approx(0.015125)
    assert labeling.cost_floor(funding=False) == pytest.approx(0.015)


def test_drawdown(spark):
    df = spark.createDataFrame([("A", at(i), r, 1) for i, r in enumerate((0.1, -0.5, 0.2))], "symbol string, ts timestamp, ret double, pred int")
    e = scoring.economics(df).first()
    assert e.max_drawdown == pytest.approx(-0.5) and e.trades == 3 and e.win_rate == pytest.approx(2 / 3)


def test_granger_finds_the_direction(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.standard_normal(400), np.zeros(400)
    for i in range(2, 400):
        y[i] = 0.3 * y[i - 1] + 0.8 * x[i - 2] + 0.3 * rng.standard_normal()
    z = rng.standard_normal(400)
    df = spark.createDataFrame([("A", at(i), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))], "symbol string, ts timestamp, x double, z double, y double")
    got = {r.feature: r for r in causal.granger(df, ["x", "z"], max_lag=3, alpha=0.01).collect()}
    assert got["x"].causal and got["x"].lag >= 2 and not got["z"].causal
    assert causal.f_tail(4.0, 2, 30) == pytest.approx(0.0288, abs=2e-4)


def test_genetic_selection():
    fit = lambda cols: 0.5 + 0.1 * len(set(cols) & {"a", "b", "c"})
    assert {"a", "b", "c"} <= set(models.select_genetic(list("abcdefgh"), lambda masks: [fit(m) for m in masks], generations=20, patience=20))


def test_schema_roles():
    assert schema.minutes("4H") == 240 and schema.minutes("?") == 5
    assert schema.is_event("vpd_event") and not schema.is_event("event_type") and schema.is_label("a_label")
    c = schema.config({"cusum": {"threshold": 1.5}})
    assert c["cusum"] == {"threshold": 1.5, "drift": 0.5, "reset": 100}
    assert [schema.detect_frame(s) for s in (30, 300, 5400, 86400, None)] == ["30s", "5min", "1.5H", "1D", "unknown"]


def test_no_feature_sees_the_future(spark):
    x = [100 + math.sin(i) + 0.01 * i for i in range(160)]

    def made(values):
        df = indicators.bollinger(indicators.realized_vol(indicators.atr(ohlc(spark, values)), 5))
        return events.all_events(df, None, {"reset": 48}, {"least": 0.1}).where(F.col("ts") < at(120)).orderBy("ts").collect()

    assert made(x) == made(x[:120])
