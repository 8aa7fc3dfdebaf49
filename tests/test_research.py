"""Events, labels, models, causal tests and decisions against hand-made or numpy values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_series import at, ohlc
from tidemark import schema
from tidemark.operators.moments import SharedFolds, logistic_singles
from tidemark.operators import agent, causal, discovery, events, frames, labeling, models, profiles, scoring


def stats(spark, **values):
    row = {"price_momentum_norm": 0.0, "volume_zscore": 0.0, "price_vol_corr": 0.0, "vol_breakout_score": 0.0, "return_zscore": 0.0, "momentum_score": 0.0} | values
    cols = ", ".join(f"{c} double" for c in row)
    return spark.createDataFrame([("A", at(0), *row.values())], f"symbol string, ts timestamp, {cols}")


@pytest.mark.parametrize(
    "values, event",
    [
        ({"vol_breakout_score": 2.5, "volume_zscore": 1.6}, True), ({"vol_breakout_score": -2.5, "price_momentum_norm": -1.6}, True), ({"vol_breakout_score": 2.5}, False),
        ({"vol_breakout_score": 1.9, "volume_zscore": 9.0}, False), ({"vol_breakout_score": 2.5, "volume_zscore": 1.6, "price_vol_corr": 0.7}, False),
        ({"vol_breakout_score": 2.5, "volume_zscore": 1.6, "price_vol_corr": None}, False), ({"vol_breakout_score": 2.5, "volume_zscore": None, "price_momentum_norm": 2.0}, True),
    ],
)
def test_volume_price_event_needs_all_clauses(spark, values, event):
    row = events.stat_events(stats(spark, **values)).first()
    assert (row.vpd_event, row.traditional_event) == (event, event)


def test_named_combinations_come_first():
    two = [n for n, _ in events.chosen(list(schema.EVENTS), 2, 50, schema.PAIRS, True)]
    assert two[0] == "covent_2way_cusum_flag_bb_upper_cross" and len(two) == 45 == len(set(two))
    assert len(events.chosen(list(schema.EVENTS), 2, 50, schema.PAIRS, False)) == 8
    three = [n for n, _ in events.chosen(list(schema.EVENTS), 3, 50, schema.TRIPLES, True)]
    assert three[:1] == ["covent_3way_cusum_flag_vpd_momentum"] and len(three) == 5 + 20 - 1


def test_bars_of_equal_close_merge_in_close_mode(spark):
    df = spark.createDataFrame([("A", at(i), 1.0, at(e), 1.0, 1.0, 1.0, c, 1.0) for i, (e, c) in enumerate([(0, 5.0), (0, 5.0), (1, 5.0), (2, 6.0)])], "symbol string, ts timestamp, close double, H_end timestamp, H_open double, H_high double, H_low double, H_close double, H_volume double")
    assert [len(frames.bars_of(df, "H", on=m).collect()) for m in ("end", "close")] == [3, 2]


def test_frames_are_found_and_validated():
    assert schema.frames_of(["1D_close", "30min_close", "4H_close"]) == ["30min", "4H", "1D"]
    schema.validate([f"30min_{c}" for c in ("open", "high", "low", "close", "volume")], "30min")
    with pytest.raises(ValueError):
        schema.validate(["close"])


def test_short_frames_have_no_indicators(spark):
    rows = frames.frame_indicators(ohlc(spark, range(1, 16)), "1D").collect()
    assert all(r["1D_rsi"] is None and r["1D_returns"] is None for r in rows)


def test_simple_barriers_and_validation(spark):
    df = ohlc(spark, [100, 101, 103, 99, 98], minutes=60).withColumn("a_event", F.col("ts") == at(0, 60))
    rows = labeling.label_events(df, "a_event", dynamic=False).collect()
    assert [(r.label, r.barrier, r.ret) for r in rows] == [(1, "profit", pytest.approx(0.0225))]
    with pytest.raises(ValueError):
        labeling.validate(df.drop("high"))
    with pytest.raises(ValueError):
        labeling.label_all(df, {"x_label": ["a_event"]}, "all")
    wide, summed = labeling.labeled(df, ["a_event"])
    assert "a_label" in wide.columns and summed.first().n == 1
    assert labeling.combined_name(["a_event", "b"]) == "a_b_combined_label"


def table(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    y = (x[:, 0] + 0.5 * rng.standard_normal(n) > 0).astype(int)
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), *map(float, x[i]), int(y[i]), float(y[i] - 0.5) / 100) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, a double, b double, c double, y int, ret double"), x, y


def test_closed_form_models(spark):
    df, x, y = table(spark)
    w, b = models.lda(df, ["a", "b", "c"])
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    pooled = (np.cov(x[y == 0].T) * ((y == 0).sum() - 1) + np.cov(x[y == 1].T) * ((y == 1).sum() - 1)) / (len(y) - 2)
    want = np.linalg.solve(pooled, m1 - m0)
    assert w == pytest.approx(want) and b == pytest.approx(np.log(y.mean() / (1 - y.mean())) - want @ (m0 + m1) / 2)
    w, b = models.ridge(df, ["a", "b", "c"], 2.0)
    z, t = (x - x.mean(0)) / x.std(0), 2 * y - 1
    want = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (t - t.mean())) / x.std(0)
    assert w == pytest.approx(want) and b == pytest.approx(t.mean() - want @ x.mean(0))
    got = models.cross_validate(df, ["a", "b"], ["lda"], 3).first()
    assert got.auc > 0.85 and got.auc_std >= 0
    assert models.holdout_economics(df, ["a"], ["lda"]).first().ret > 0
    assert "a" in models.genetic_selection(df, ["a", "b", "c"], population=4, generations=2, least=1)


def test_granger_of_all_lags_in_one_pass(spark):
    rng = np.random.default_rng(5)
    x, z = rng.standard_normal((2, 400))
    y = np.zeros(400)
    for i in range(2, 400):
        y[i] = 0.3 * y[i - 1] + 0.8 * x[i - 2] + 0.3 * rng.standard_normal()
    rows = [("A", at(i), float(x[i]), float(z[i]), float(y[i])) for i in range(400)]
    got = {r.feature: r for r in causal.granger(spark.createDataFrame(rows, "symbol string, ts timestamp, x double, z double, y double"), ["x", "z"], max_lag=3).collect()}
    assert got["x"].causal and got["x"].lag == 2 and not (got["z"].causal and got["z"].p < 0.01)
    own = np.column_stack([np.ones(398), y[1:399], y[:398]])
    full = np.column_stack([own, x[1:399], x[:398]])
    rss = [((y[2:] - a @ np.linalg.lstsq(a, y[2:], rcond=None)[0]) ** 2).sum() for a in (own, full)]
    assert got["x"].f == pytest.approx((rss[0] - rss[1]) / 2 / (rss[1] / (398 - 5)))


def test_correlated_columns_keep_the_best(spark):
    df, *_ = table(spark)
    df = df.withColumn("d", F.col("a") + F.col("b") * 0.01)
    gone = {r.feature for r in scoring.correlated_worse(df, ["a", "b", "d"]).collect()}
    best = max(("a", "d"), key=lambda c: abs(df.select(F.corr(c, "y")).first()[0]))
    assert gone == {"a", "d"} - {best}


def test_decisions():
    assert agent.selection_method("breakout", 101, "CRISIS") == "statistical" and agent.selection_method("breakout", 5, "CRISIS") == "correlation_analysis"
    assert agent.selection_method("", 5, "CRISIS") == "statistical" and agent.selection_method("", 5, "BULL_LOW_VOL") == "mutual_info"
    assert agent.choose_models(["naive_bayes"], "breakout", "BULL_LOW_VOL", 5, 0.6)[0] == "naive_bayes"
    told = agent.reason({"quality": 0.5, "frequency": 0.01}, "momentum", "CRISIS")
    assert told["confidence"] == pytest.approx(0.5 * 0.8 * 0.9 * 0.8) and len(told["insights"]) == 4
    assert [i["type"] for i in agent.insights("x", [{"model": "a", "auc": 0.6, "ret": 0.1}, {"model": "b", "auc": 0.61, "ret": 0.0}], "CRISIS", 0.8, ["f"])] == ["feature_selection", "profitable_strategy", "market_regime_warning", "model_similarity"]
    assert discovery.hypotheses_for("momentum_event", ["volume"]) == ["momentum_persistence"]
    assert len(discovery.hypotheses_for("outlier_event", [])) == 4 and discovery.mechanism("atr_pct_20") == "volatility_clustering"


def test_sessions_stop_in_time(spark):
    s = agent.Session(spark, seconds=0.0)
    assert s.run(["a_label"], lambda label: None) is None and s.skipped == ["a_label"]
    out = discovery.investigate(spark, ["a", "b"], lambda e: None, seconds=0.0)
    assert out["skipped"] == ["a", "b"] and out["known"].count() == 0
    assert "Validate" in discovery.report(out["known"])


def test_event_kinds(spark):
    df = spark.createDataFrame([("momentum_event", 0.1), ("vpd_volatility", 0.1), ("x", 0.01), ("x2", 0.5), ("x3", 0.1)], "event string, frequency double")
    assert [r.kind for r in profiles.event_kind(df).collect()] == ["momentum", "volatility", "breakout", "momentum", "mean_reversion"]


def test_shared_folds(spark):
    """Moments of segments give each fold and mask the weights and AUC of a fit on its own rows; one job scores a population."""
    df, *_ = table(spark, 240)
    folds = SharedFolds(df, ["a", "b", "c"], 3)
    masks = [("a",), ("b",), ("a", "c"), ("a", "b", "c")]
    for model in ("lda", "ridge"):
        want = [models.cross_validate(df, list(m), [model], 3).first()["auc"] for m in masks]
        assert folds.aucs(masks, model) == pytest.approx(want, abs=1e-9)
    runs = []
    plain = folds.aucs
    folds.aucs = lambda *a: runs.append(1) or plain(*a)
    models.SharedFolds, kept = (lambda *a: folds), models.SharedFolds
    try:
        assert "a" in models.genetic_selection(df, ["a", "b", "c"], "lda", 3, population=8, generations=3, least=1)
    finally:
        models.SharedFolds = kept
    assert len(runs) <= 3


def test_logistic_singles(spark):
    """Every key's fit meets the score equations; keys of one class or one value keep their log odds."""
    rng = np.random.default_rng(8)
    rows = []
    for key, slope in (("up", 2.0), ("down", -0.5), ("none", 0.0)):
        x = rng.normal(3, 2, 300)
        rows += [(key, 0, float(v), float(rng.random() < 1 / (1 + np.exp(-slope * (v - 3))))) for v in x]
    rows += [("same", 0, 1.0, float(i % 2)) for i in range(10)] + [("ones", 1, float(i), 1.0) for i in range(10)]
    fits = logistic_singles(spark.createDataFrame(rows, "feature string, fold int, x double, y double"), ["feature", "fold"])
    for key in ("up", "down", "none"):
        x, y = (np.array([r[i] for r in rows if r[0] == key]) for i in (2, 3))
        p = 1 / (1 + np.exp(-(fits[key, 0][0] + fits[key, 0][1] * x)))
        assert abs((y - p).sum()) < 1e-6 and abs(((y - p) * x).sum()) < 1e-5
    assert fits["same", 0] == (0.0, 0.0) and fits["ones", 1][1] == 0.0 and fits["ones", 1][0] > 10


def test_economic_validation(spark):
    df, *_ = table(spark)
    got = {r.feature: r for r in discovery.economic_validation(df, ["a", "b"]).collect()}
    assert got["a"].auc > 0.85 > got["b"].auc and got["a"].total > 0 and got["a"].n_folds == 3
    slow = {r.feature: r for r in discovery.economic_validation(df, ["a"], "lda").collect()}
    assert slow["a"].auc == pytest.approx(got["a"].auc)
