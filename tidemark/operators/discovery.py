"""Discovery of features that lead a target: tests combined into ranked relationships, knowledge and reports.

Tests run in Spark; what they give is one row a feature, combination or relationship.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from itertools import combinations
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import causal, models, scoring
from tidemark.operators.moments import logistic_singles
from tidemark.operators.series import over
from tidemark.storage import store

# Economic mechanisms, with the impact that is typical of them.
MECHANISMS = {
    "information_asymmetry": ("Informed traders cause price movements before public information", "high"),
    "liquidity_provision": ("Market makers adjust quotes based on inventory and order flow", "medium"),
    "momentum_herding": ("Past returns cause future returns through behavioral herding", "medium"),
    "mean_reversion": ("Prices revert to fundamental value after deviations", "medium"),
    "volatility_clustering": ("High volatility periods cause future high volatility", "high"),
    "order_flow_impact": ("Order flow directly impacts prices through market mechanics", "very_high"),
}
# The strength to expect of an impact.
IMPACT = {"very_high": 0.8, "high": 0.6, "medium": 0.4, "low": 0.2}
# The mechanisms behind some features.
THEORY = {
    **dict.fromkeys(("volume", "volume_sma", "volume_ratio", "volume_imbalance"), ("order_flow_impact", "information_asymmetry", "liquidity_provision")),
    **dict.fromkeys(("atr", "atr_pct", "vol_realized"), ("volatility_clustering", "information_asymmetry")),
    **dict.fromkeys(("returns", "log_returns", "price_momentum", "rsi"), ("momentum_herding", "mean_reversion")),
    **dict.fromkeys(("bid_ask_spread", "effective_spread", "market_depth"), ("liquidity_provision", "information_asymmetry")),
}
# Hypotheses, their mechanism and the features they speak of.
HYPOTHESES = {
    "momentum_persistence": ("momentum_herding", ("past_returns", "volume", "volatility")), "volatility_clustering": ("volatility_clustering", ("past_volatility", "volume")),
    "mean_reversion_deviations": ("mean_reversion", ("price_deviation", "volatility")), "order_flow_impact": ("order_flow_impact", ("volume", "order_imbalance", "trade_size")),
}
# Words in an event's name that call for a mechanism's hypothesis.
CALLS = {"momentum_herding": ("momentum", "trend"), "volatility_clustering": ("vol",), "mean_reversion": ("reversion", "bounce"), "order_flow_impact": ("volume", "flow")}
RAW = ("open", "high", "low", "close")


def hypotheses_for(event: str, features: list[str]) -> list[str]:
    """Hypotheses that the event's name calls for and that speak of an available feature; all if there are none."""
    called = [h for h, (m, _) in HYPOTHESES.items() if any(w in event.lower() for w in CALLS[m])]
    return [h for h in called if set(HYPOTHESES[h][1]) & set(features)] or list(HYPOTHESES)


def mechanism_of(feature: Column, event: Column, lag: Column) -> Column:
    """The likeliest mechanism by the feature's and the event's names."""
    f, e = F.lower(feature), F.lower(event)
    return (
        F.when(f.contains("volume"), F.when(F.coalesce(lag, F.lit(1)) <= 1, "order_flow_impact").otherwise("information_asymmetry"))
        .when(f.contains("volatility") | f.contains("atr"), "volatility_clustering")
        .when(f.contains("return") | f.contains("momentum"), F.when(e.contains("momentum"), "momentum_herding").otherwise("mean_reversion"))
        .when(f.contains("spread") | f.contains("liquidity"), "liquidity_provision").otherwise("information_asymmetry")
    )


def mechanism(name: str) -> str:
    """The first mechanism that theory gives for a feature whose name starts the same."""
    return next((m[0] for k, m in THEORY.items() if name.lower().startswith(k)), "unknown")


def plausibility(rows: DataFrame, features: list[str], events: list[str]) -> DataFrame:
    """Rows (feature, event, strength) with `plausible` and `confidence`: 0.5 for features without theory, 0.3 where the
    event fits no mechanism of the feature, 0.2 where the relationship is weak for the mechanism, else strength over
    the expected one, at most 1. Nothing is implausible; the confidence tells."""
    expected: Column = F.lit(None).cast("double")
    known: Column = F.lit(False)
    for f in features:
        for e in events:
            words = set(e.lower().split("_"))
            fits = [m for m in THEORY.get(f, ()) if words & set(MECHANISMS[m][0].lower().split())]
            if fits:
                expected = F.when((F.col("feature") == f) & (F.col("event") == e), F.lit(IMPACT[MECHANISMS[fits[0]][1]])).otherwise(expected)
        known = known | ((F.col("feature") == f) & F.lit(f in THEORY))
    sure = F.when(~known, 0.5).when(expected.isNull(), 0.3).when(F.col("strength") < expected * 0.2, 0.2).otherwise(F.least(F.lit(1.0), F.col("strength") / expected))
    return rows.withColumn("plausible", F.lit(True)).withColumn("confidence", sure)


def combinations_of(columns: list[str], singles: int = 20, size: int = 3, most: int = 60) -> list[tuple[str, ...]]:
    """Singles, pairs of the first ten and ten triples, then groups of one mechanism; each set once."""
    usable = [c for c in columns if c not in RAW]
    out = [(c,) for c in usable[:singles]] + list(combinations(usable[:10], 2)) + list(combinations(usable[:10], 3))[:10]
    for m in dict.fromkeys(map(mechanism, usable)):
        out.append(tuple(c for c in usable if mechanism(c) == m)[:size])
    return list(dict.fromkeys(tuple(sorted(c)) for c in out if 0 < len(c) <= size))[:most]


def multivariate(df: DataFrame, columns: tuple[str, ...], y: str = "y", lag: int = 1) -> tuple[float, float]:
    """F and p of y on its own lags against those and all columns' lags; lag * columns numerator degrees."""
    names = ["_one", *[f"_y{i}" for i in range(1, lag + 1)], *[f"_{c}{i}" for c in columns for i in range(1, lag + 1)], "_y0"]
    own = [F.lag(F.col(y).cast("double"), i).over(over()).alias(f"_y{i}") for i in range(1, lag + 1)]
    rest = [F.lag(F.col(c).cast("double"), i).over(over()).alias(f"_{c}{i}") for c in columns for i in range(1, lag + 1)]
    rows = df.select(F.lit(1.0).alias("_one"), F.col(y).cast("double").alias("_y0"), *own, *rest).na.drop()
    row = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    k = len(names)
    s = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            s[i, j] = s[j, i] = row[f"s{i}_{j}"] or 0.0
    rss = []
    for use in (list(range(lag + 1)), list(range(k - 1))):
        b = s[use, k - 1]
        rss.append(max(s[-1, -1] - b @ np.linalg.lstsq(s[np.ix_(use, use)], b, rcond=None)[0], 0.0))
    d1, d2 = lag * len(columns), s[0, 0] - (k - 1)
    if d2 <= 0 or rss[1] <= 0:
        return 0.0, 1.0
    f = (rss[0] - rss[1]) / d1 / (rss[1] / d2)
    return float(f), float(causal.f_tail(f, d1, d2))


def discover(df: DataFrame, columns: list[str], y: str = "y", max_lag: int = 2, most: int = 50, least: float = 0.05, event: str = "event") -> DataFrame:
    """Per feature: best lag's F test, split stability, temporal order; those with any test or a strength above `least`,
    the strongest first, with the relationship's type and mechanism. Raw prices are left out, `most` features are tried."""
    columns = [c for c in columns if c not in RAW][:most]
    tests = causal.granger(df, columns, y, max_lag).select("feature", "lag", F.col("p").alias("granger_p"), F.col("strength").alias("s1"), "causal")
    named = df.withColumn("y", F.col(y).cast("double"))
    parts = causal.split_stability(named, columns).select("feature", "mean_r", "stability", F.col("strength").alias("s2"), "structural")
    order = causal.temporal(named, columns, "y", max_lag).select("feature", "lead", F.col("strength").alias("s3"), "ordered")
    out = tests.join(parts, "feature", "full").join(order, "feature", "full")
    level = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in ("s1", "s2", "s3")])
    out = out.withColumn("strength", level)
    any_ = F.coalesce("causal", F.lit(False)) | F.coalesce("structural", F.lit(False)) | F.coalesce("ordered", F.lit(False))
    out = causal.relationship(out.where(any_ | (F.col("strength") > least))).withColumn("mechanism", mechanism_of(F.col("feature"), F.lit(event), F.col("lag")))
    return out.drop("s1", "s2", "s3").orderBy(F.desc("strength"), "feature")


def out_of_sample(df: DataFrame, columns: list[str], start: str, y: str = "y", max_lag: int = 2) -> DataFrame:
    """Strength before and from `start`; valid where it is still causal and lost less than half."""
    a = causal.granger(df.where(F.col("ts") < start), columns, y, max_lag).select("feature", F.col("strength").alias("before"))
    b = causal.granger(df.where(F.col("ts") >= start), columns, y, max_lag).select("feature", F.col("strength").alias("after"), "causal")
    return a.join(b, "feature").withColumn("valid", F.col("causal") & (F.col("after") > 0.5 * F.col("before"))).drop("causal")


def predictive_power(df: DataFrame, columns: tuple[str, ...], model: str = "logistic", k: int = 3, least: float = 0.55) -> tuple[float, float, bool]:
    """Mean AUC of ordered folds, the strength 2 (AUC - 0.5), and whether it is above `least`; y is 0 or 1."""
    auc = models.cross_validate(df.na.drop(subset=[*columns, "y"]), list(columns), [model], k).first()["auc"]
    auc = 0.5 if auc is None else auc
    return auc, max(0.0, 2 * (auc - 0.5)), auc > least


def discover_combinations(df: DataFrame, groups: list[tuple[str, ...]], model: str = "logistic", k: int = 3, lag: int = 1, alpha: float = 0.1, least: float = 0.1) -> DataFrame:
    """Combinations that are causal or predictive and strong enough, the strongest first."""
    out = []
    for g in groups:
        f, p = multivariate(df, g, "y", lag)
        auc, power, predictive = predictive_power(df, g, model, k)
        strength = 1 - p if p < alpha else 0.0
        if (p < alpha or predictive) and max(strength, power) > least:
            out.append(("+".join(g), len(g), f, p, auc, strength, power, max(strength, power), p < alpha, predictive))
    schema = "combination string, size int, f double, p double, auc double, causal_strength double, predictive_strength double, strength double, causal boolean, predictive boolean"
    return df.sparkSession.createDataFrame(out, schema).orderBy(F.desc("strength"), "combination")


def best_approach(singles: DataFrame, groups: DataFrame) -> DataFrame:
    """The strongest of single features and combinations: (approach, name, strength)."""
    a = singles.select(F.lit("single").alias("approach"), F.col("feature").alias("name"), "strength")
    b = groups.select(F.lit("combination").alias("approach"), F.col("combination").alias("name"), "strength")
    return a.union(b).orderBy(F.desc("strength"), "name").limit(1)


def economic_validation(df: DataFrame, features: list[str], model: str = "logistic", k: int = 3) -> DataFrame:
    """Per feature: AUC over folds of a model on it alone, the return of the rows it calls, Sharpe over the folds'
    returns, and AUC * (1 + |return|). Rows hold y and ret. Logistic fits of all features and folds share their passes."""
    placed = scoring.folds(df.select("symbol", "ts", *features, "ret", F.col("y").cast("double").alias("y")), k)
    if model == "logistic":
        rows = store(scoring.long(placed.withColumn("ret", F.coalesce("ret", F.lit(0.0))), features, ("fold", "role", "y", "ret")))
        fits = logistic_singles(rows.where("role = 'train' and x is not null"), ["feature", "fold"])
        fits = df.sparkSession.createDataFrame([(*key, *ab) for key, ab in fits.items()], "feature string, fold int, a double, b double")
        score = F.col("a") + F.col("b") * F.col("x")
        out = rows.where("role = 'test' and x is not null").join(F.broadcast(fits), ["feature", "fold"])  # one row a feature and fold
        out = out.select("feature", "fold", score.alias("score"), (score > 0).cast("int").alias("pred"), F.col("y").cast("int").alias("y"), "ret")
    else:
        part = lambda i, role: placed.where((F.col("fold") == i) & (F.col("role") == role))
        out = None
        for f in features:
            for i in range(k):
                t = models.scored(part(i, "train"), part(i, "test"), [f], model).select(F.lit(f).alias("feature"), F.lit(i).alias("fold"), "score", "pred", F.col("y").cast("int").alias("y"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
                out = t if out is None else out.union(t)
    by = ["feature", "fold"]
    money = out.groupBy(*by).agg(F.sum(F.when(F.col("pred") == 1, F.col("ret")).otherwise(0.0)).alias("total"))
    g = scoring.auc(out, by).join(money, by).groupBy("feature").agg(
        F.coalesce(F.avg("auc"), F.lit(0.5)).alias("auc"), F.sum("total").alias("total"), F.coalesce(F.try_divide(F.avg("total"), F.nullif(F.stddev_pop("total"), F.lit(0.0))), F.lit(0.0)).alias("sharpe"), F.count("auc").alias("n_folds")
    )
    return g.withColumn("economic_score", F.col("auc") * (1 + F.abs("total")))


def keep_knowledge(known: DataFrame | None, found: DataFrame, results: DataFrame, least_return: float = -0.05) -> DataFrame:
    """Relationships (event, feature, mechanism, strength) with their total return, added to what is known; those that lost more don't enter."""
    new = found.join(results.select("feature", "total"), "feature").where(F.col("total") > least_return).select("event", "feature", "mechanism", "strength", "total")
    return new if known is None else known.unionByName(new)


def recall_knowledge(known: DataFrame, event: str, least: float = 0.3) -> DataFrame:
    return known.where((F.col("event") == event) & (F.col("strength") >= least)).orderBy(F.desc("strength"), "feature")


def preferred_mechanisms(known: DataFrame) -> DataFrame:
    """Mean return and number of relationships of each mechanism."""
    return known.groupBy("mechanism").agg(F.avg("total").alias("mean_return"), F.count("*").alias("n"))


def insight(known: DataFrame) -> DataFrame:
    """Per event: relationships, their dominant mechanism, total strength, mean return and confidence (mean strength, at most 1)."""
    n = F.count("*").over(Window.partitionBy("event", "mechanism"))
    g = known.withColumn("_n", n).groupBy("event").agg(
        F.count("*").alias("n"), F.max_by("mechanism", F.struct("_n", "mechanism")).alias("dominant"), F.sum("strength").alias("total_strength"), F.avg("total").alias("mean_return")
    )
    return g.withColumn("confidence", F.least(F.lit(1.0), F.col("total_strength") / F.col("n")))


def untested(pairs: DataFrame, failed: DataFrame) -> DataFrame:
    """(feature, event) pairs that have not failed before."""
    return pairs.join(failed.select("feature", "event").distinct(), ["feature", "event"], "left_anti")


def analysis(known: DataFrame, paid: float = 0.01) -> DataFrame:
    """(kind, name, n, mean_strength, mean_return, profitable): all relationships, the five commonest mechanisms and ten features."""
    def by(kind: str, name: Column, most: int) -> DataFrame:
        g = known.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.avg("strength").alias("mean_strength"), F.avg("total").alias("mean_return"), F.count_if(F.col("total") > paid).alias("profitable"))
        return g.orderBy(F.desc("n"), "name").limit(most).select(F.lit(kind).alias("kind"), "*")

    return by("all", F.lit("all"), 1).union(by("mechanism", F.col("mechanism"), 5)).union(by("feature", F.col("feature"), 10))


def investigate(spark: SparkSession, events: Iterable[str], get: Callable[[str], tuple[DataFrame, list[str]]], seconds: float = 1800.0, stop: float = 0.9, max_lag: int = 2, model: str = "logistic", mechanisms: tuple[str, ...] = ()) -> dict[str, Any]:
    """Discovery, validation and knowledge over events, until `stop` of the time is used; get gives a frame (y, ret) and columns.

    Only relationships of `mechanisms`, if given, are validated. Returns known, failed and skipped events.
    """
    start, known, failed, skipped = time.monotonic(), None, [], []
    for event in events:
        if time.monotonic() - start > stop * seconds:
            skipped.append(event)
            continue
        df, columns = get(event)
        found = discover(df, columns, "y", max_lag, event=event).withColumn("event", F.lit(event))
        if mechanisms:
            found = found.where(F.col("mechanism").isin(*mechanisms))
        names = [r.feature for r in found.select("feature").collect()]
        if not names:
            failed.append(event)
            continue
        known = keep_knowledge(known, found, economic_validation(df, names, model))
    if known is None:
        known = spark.createDataFrame([], "event string, feature string, mechanism string, strength double, total double")
    return {"known": known, "failed": failed, "skipped": skipped}


def quick(spark: SparkSession, events: list[str], get) -> dict[str, Any]:
    """Three events, one lag, ten minutes at most."""
    return investigate(spark, events[:3], get, 600.0, max_lag=1, model="lda")


def deep(spark: SparkSession, events: list[str], get) -> dict[str, Any]:
    return investigate(spark, events, get, 4 * 3600.0, max_lag=5)


def focused(spark: SparkSession, events: list[str], get, mechanisms: tuple[str, ...], least: float = 0.3) -> dict[str, Any]:
    """Only relationships of the mechanisms, at least that strong."""
    out = investigate(spark, events, get, mechanisms=mechanisms)
    return out | {"known": out["known"].where(F.col("strength") >= least)}


def report(known: DataFrame) -> str:
    """A text summary of the analysis; one line a row."""
    rows = analysis(known).collect()
    lines = [f"{r.kind} {r.name}: {r.n} relationships, strength {r.mean_strength:.3f}, return {r.mean_return:.4f}, profitable {r.profitable}" for r in rows]
    strong = next((r.mean_strength for r in rows if r.kind == "all"), 0.0)
    lines.append("Strong relationships: turn to portfolio and risk" if strong >= 0.5 else "Longer series or other features would strengthen the relationships")
    return "\n".join([*lines, "Validate out of sample before use"])
