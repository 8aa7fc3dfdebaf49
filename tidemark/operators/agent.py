"""Decisions of a research session: what to select by, which models to try, what the results suggest.

The tables behind the decisions are small (one row an event, feature, model or run group); what is
computed over the data stays in Spark.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import memory, models, profiles, scoring
from tidemark.storage import store

# Model sets by situation and the models that kinds of events prefer.
EXPLORE = ("random_forest", "logistic", "naive_bayes")
EXPLOIT = ("random_forest", "gradient_boosting")
CRISIS = ("ridge", "logistic", "lda")
PREFERRED = {
    "breakout": ("random_forest", "gradient_boosting", "linear_svm"), "mean_reversion": ("logistic", "ridge", "lda"), "momentum": ("gradient_boosting",),
    "volatility": ("random_forest", "gradient_boosting"), "volume": ("naive_bayes", "random_forest"), "pattern": ("linear_svm", "gradient_boosting"),
}
# Feature groups, horizons and risks of some kinds of events.
APPROACH = {
    "breakout": {"features": "price_action_and_volume", "time_horizon": "short_term", "risk": "high_false_positive_risk", "insight": "a break of a level counts once volume goes with it"},
    "mean_reversion": {"features": "statistical_indicators", "time_horizon": "medium_term", "risk": "timing_critical", "insight": "returns to the mean are likelier where there is no trend"},
    "momentum": {"features": "trend_and_momentum_indicators", "time_horizon": "variable", "risk": "regime_dependent", "insight": "how long a move lasts depends on the regime"},
}


def selection_method(kind: str, n_features: int, regime: str) -> str:
    """The way to score features: by their number, the kind of event, then the regime."""
    if n_features > 100:
        return "statistical"
    by_kind = {"breakout": "correlation_analysis", "momentum": "mutual_info", "volatility": "random_forest", "mean_reversion": "synergy_based", "pattern": "synergy_based"}
    return by_kind.get(kind, "statistical" if regime == "CRISIS" else "mutual_info")


def synergy_selection(df: DataFrame, columns: list[str], synergies: DataFrame, k: int) -> list[str]:
    """The columns most correlated with y, each followed by its known good partners; synergies has (a, b, n, mean_auc)."""
    ranked = [r.feature for r in scoring.target_correlation(df, columns).orderBy(F.desc_nulls_last("r"), "feature").limit(2 * k).collect()]
    good = [(r.a, r.b) for r in synergies.where("n > 2 and mean_auc > 0.6").orderBy(F.desc("mean_auc"), "a", "b").select("a", "b").collect()]
    chosen: list[str] = []
    for f in ranked:
        for x in (f, *(b if a == f else a for a, b in good if f in (a, b))):
            if x in columns and x not in chosen and len(chosen) < k:
                chosen.append(x)
    return chosen


def select(df: DataFrame, columns: list[str], method: str, k: int, preferred: tuple[str, ...] = (), synergies: DataFrame | None = None) -> list[str]:
    """The k best columns by a method; preferred ones count 1.2 (mutual information 1.3) times."""
    if method == "synergy_based" and synergies is not None:
        return synergy_selection(df, columns, synergies, k)
    if method == "mutual_info":
        scores, boost = scoring.mutual_information(df, columns).withColumnRenamed("mi", "score"), 1.3
    elif method == "statistical":
        scores, boost = scoring.anova(df, columns).withColumnRenamed("f", "score"), 1.2
    elif method == "random_forest":
        scores, boost = models.importances(df, columns), 1.2
    else:
        scores, boost = scoring.target_correlation(df, columns, preferred, boost=True).withColumnRenamed("r", "score"), 1.0
    scores = scores.withColumn("score", F.col("score") * F.when(F.col("feature").isin(*preferred), boost).otherwise(1.0))
    return [r.feature for r in scoring.top_features(scores, k).collect()]


def selection_confidence(df: DataFrame, chosen: list[str], preferences: DataFrame, synergies: DataFrame) -> float:
    """min(1, mean information + 0.1 * mean regime preference + 0.2 * mean synergy) of the chosen columns."""
    if not chosen:
        return 0.0
    mi = scoring.mutual_information(df, chosen).agg(F.avg("mi")).first()[0] or 0.0
    liked = preferences.where(F.col("feature").isin(*chosen)).agg(F.sum("preference")).first()[0] or 0.0
    both = synergies.where(F.col("a").isin(*chosen) & F.col("b").isin(*chosen)).agg(F.sum("mean_auc")).first()[0] or 0.0
    pairs = len(chosen) * (len(chosen) - 1) / 2
    return min(1.0, mi + 0.1 * liked / len(chosen) + 0.2 * (both / pairs if pairs else 0.0))


def choose_models(known: list[str], kind: str, regime: str, n_features: int, exploration: float, most: int = 5) -> list[str]:
    """Models by score: rank among known good ones (3 a place), the situation's and the event kind's sets (2 each)."""
    score: dict[str, float] = {}
    add = lambda names, n: [score.__setitem__(m, score.get(m, 0.0) + n) for m in names]
    for i, m in enumerate(known[:5]):
        add([m], (5 - i) * 3)
    add(EXPLORE if exploration > 0.7 else CRISIS if regime == "CRISIS" else EXPLOIT, 2)
    add(PREFERRED.get(kind, ("random_forest", "logistic")), 2)
    if n_features > 50:
        add(("random_forest", "lda"), 1)
    return sorted(score, key=lambda m: -score[m])[:most]


def reason(event: dict[str, Any], kind: str, regime: str) -> dict[str, Any]:
    """Confidence and insights about an event; event has frequency and quality."""
    confidence, insights = 0.5, [APPROACH[kind]["insight"]] if kind in APPROACH else []
    for holds, factor, text in (
        (regime == "CRISIS", 0.8, "in a crisis, prefer few features and simple models"), (regime == "SIDEWAYS_LOW_VOL", 1.2, "a calm sideways market favours returns to the mean"),
        (event["quality"] < 0.8, 0.9, "the data has gaps; fill and screen it with care"), (event["frequency"] < 0.05, 0.8, "few cases: a fit may not carry over"),
        (event["frequency"] > 0.4, 0.9, "so frequent an event may say little"),
    ):
        if holds:
            confidence *= factor
            insights.append(text)
    return {"kind": kind, "regime": regime, "approach": {k: v for k, v in APPROACH.get(kind, {}).items() if k != "insight"}, "confidence": confidence, "insights": insights}


def insights(label: str, results: list[dict[str, Any]], regime: str, confidence: float, features: list[str]) -> list[dict[str, Any]]:
    """What a label's results (model, auc, ret, ...) suggest."""
    out = []
    if confidence > 0.7:
        out.append({"type": "feature_selection", "confidence": confidence, "text": f"{label}: key features {', '.join(features[:3])}"})
    best = max(results, key=lambda r: r["ret"], default=None)
    if best and best["ret"] > 0.05:
        out.append({"type": "profitable_strategy", "confidence": 0.8, "text": f"{label}: {best['model']} returns {best['ret']:.3f}"})
    if regime in ("CRISIS", "SIDEWAYS_HIGH_VOL"):
        out.append({"type": "market_regime_warning", "confidence": 0.9, "text": f"found in {regime}; may need adaptation elsewhere"})
    if len(results) > 1 and max(r["auc"] for r in results) - min(r["auc"] for r in results) < 0.05:
        out.append({"type": "model_similarity", "confidence": 0.7, "text": f"{label}: models are alike; take the simpler one"})
    return out


def recommendations(runs: DataFrame, regime: str) -> list[str]:
    """Recommendations from all runs, by their best labels, models, features and risks."""
    out = []
    top = runs.groupBy("label").agg(F.max("ret").alias("ret")).orderBy(F.desc("ret"), "label").limit(3).collect()
    if top:
        out.append(f"Focus on: {', '.join(r.label for r in top)}; combined return {sum(r.ret for r in top):.4f}")
        models_ = memory.learn(runs).where("success").groupBy("model").count().orderBy(F.desc("count"), "model").limit(1).collect()
        out += [f"Primary model: {r.model} ({r['count']} successful runs)" for r in models_]
        out.append("Key features: " + ", ".join(r.feature for r in memory.common_features(runs, 5).collect()))
    risky = runs.where("ret > 0.05 and sharpe < 0.5").select("label").distinct().orderBy("label").limit(20).collect()
    if risky:
        out.append(f"High return but risky: {', '.join(r.label for r in risky)}")
    out += {"CRISIS": ["Crisis: defensive strategies and robust models"], "BULL_LOW_VOL": ["Bull market: momentum may do well"], "BULL_HIGH_VOL": ["Bull market: momentum may do well"]}.get(regime, [])
    return out


def prepare(df: DataFrame, columns: list[str], regime: str = "") -> tuple[DataFrame, list[str]]:
    """Filled features without constant, correlated and outlier-heavy ones; a crisis fills backwards first and keeps outliers."""
    crisis = regime == "CRISIS"
    df = scoring.fill(df, columns, crisis=crisis)
    gone = {r.feature for r in scoring.variances(df, columns).where("constant").collect()}
    columns = [c for c in columns if c not in gone]
    if len(columns) > 1:
        gone = {r.feature for r in scoring.correlated_worse(df, columns, 0.98 if crisis else 0.95).collect()}
        columns = [c for c in columns if c not in gone]
    gone = {r.feature for r in scoring.outlier_heavy(df, columns, crisis=crisis).collect()}
    return df, [c for c in columns if c not in gone]


RUN_SCHEMA = "run_id long, label string, regime string, model string, auc double, f1 double, precision double, ret double, sharpe double, win_rate double, trades long, features array<string>"
RUN_COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]


@dataclass
class Session:
    """A research session over labels with a time budget; it stops after `stop` of it, between labels.

    run() takes a function label -> (frame with y and ret, feature columns) and gives a table of runs.
    """

    spark: Any
    regime: str = "SIDEWAYS_LOW_VOL"
    k: int = 3
    folds: int = 3
    seconds: float = 3600.0
    stop: float = 0.9
    runs: DataFrame | None = None
    skipped: list[str] = field(default_factory=list)

    def one(self, label: str, df: DataFrame, columns: list[str], kind: str = "") -> DataFrame:
        """Runs of one label: prepared features, the kind's selection, chosen models by ordered folds, economics of the last 30 percent."""
        df, columns = prepare(df, columns, self.regime)
        synergies = memory.synergies(self.runs) if self.runs is not None else None
        chosen = select(df, columns, selection_method(kind, len(columns), self.regime), self.k, (), synergies)
        known = [r.model for r in memory.model_scores(self.runs).orderBy(F.desc("score"), "model").limit(5).collect()] if self.runs is not None else []
        names = choose_models(known, kind, self.regime, len(chosen), memory.EXPLORATION.get(self.regime, 0.6))
        scores = models.cross_validate(df, chosen, names, self.folds)
        money = models.holdout_economics(df, chosen, names)
        rows = scores.join(money, "model")
        return rows.select(F.lit(label).alias("label"), F.lit(self.regime).alias("regime"), "model", "auc", "f1", "precision", "ret", "sharpe", "win_rate", "trades", F.lit(chosen).cast("array<string>").alias("features"))

    def run(self, labels: Iterable[str], get: Callable[[str], tuple[DataFrame, list[str]]]) -> DataFrame | None:
        start = time.monotonic()
        n = 0 if self.runs is None else (self.runs.agg(F.max("run_id")).first()[0] or -1) + 1
        for label in labels:
            if time.monotonic() - start > self.stop * self.seconds:
                self.skipped.append(label)
                continue
            kind = next((k for k, words in profiles.KINDS.items() if any(w in label.lower() for w in words)), "")
            # the table of runs is small: one row a model and label
            rows = [(n + i, *r) for i, r in enumerate(self.one(label, *get(label), kind).orderBy("model").collect())]
            n += len(rows)
            new = self.spark.createDataFrame(rows, RUN_SCHEMA)
            self.runs = new if self.runs is None else self.runs.union(new)
        return self.runs


def quick(spark, labels: list[str], get, regime: str = "SIDEWAYS_LOW_VOL") -> DataFrame | None:
    """The first three labels, two features, two folds, ten minutes at most."""
    return Session(spark, regime, k=2, folds=2, seconds=600.0).run(labels[:3], get)


def deep(spark, labels: list[str], get, regime: str = "SIDEWAYS_LOW_VOL") -> DataFrame | None:
    return Session(spark, regime, k=15, folds=3, seconds=2 * 3600.0).run(labels, get)


def adaptive(spark, labels: list[str], get, profile: DataFrame, regime: str = "SIDEWAYS_LOW_VOL", seconds: float = 3600.0) -> DataFrame | None:
    """Labels in the order of their priority."""
    order = [r.event for r in memory.strategy(profile).orderBy("place").select("event").collect()]
    return Session(spark, regime, seconds=seconds).run([x for x in order if x in labels] + [x for x in labels if x not in order], get)


def research(df: DataFrame, columns: list[str], k: int = 10, names: tuple[str, ...] = ("logistic", "random_forest", "gradient_boosting"), folds: int = 3) -> dict[str, Any]:
    """All steps for one label (y, ret): prepared columns, combined scores, chosen features, models' metrics and ranks, economics, stability."""
    df, columns = prepare(store(df.select("symbol", "ts", *columns, "y", "ret")), columns)
    df = store(df)  # read by every step below
    parts = [scoring.mutual_information(df, columns).select(F.lit("mi").alias("method"), "feature", F.col("mi").alias("score"))]
    parts += [scoring.anova(df, columns).select(F.lit("anova"), "feature", "f"), models.importances(df, columns).select(F.lit("forest"), "feature", "score"), scoring.target_correlation(df, columns).select(F.lit("corr"), "feature", "r")]
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.union(p)
    scores = scoring.combine(scores)
    chosen = [r.feature for r in scoring.top_features(scores, k).collect()]
    ranked = scoring.rank_models(models.cross_validate(df, chosen, list(names), folds))
    return {"features": chosen, "scores": scores, "models": ranked, "economics": models.holdout_economics(df, chosen, list(names)), "stability": scoring.stability(df, chosen)}


def quick_research(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    return research(df, columns, 5, ("logistic",), 2)


def compare_sets(df: DataFrame, sets: dict[str, list[str]], names: list[str], folds: int = 3) -> DataFrame:
    """(feature_set, model, metrics): the same models on each set of features."""
    out = None
    for key, columns in sets.items():
        part = models.cross_validate(df, columns, names, folds).withColumn("feature_set", F.lit(key))
        out = part if out is None else out.union(part)
    return out
