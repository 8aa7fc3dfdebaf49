"""What research runs teach: successes, synergies, recency-weighted models, rankings, reports.

Runs are rows (run_id, label, regime, model, auc, f1, precision, ret, sharpe, win_rate, trades, features).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a successful run reaches, in all of them.
SUCCESS = {"auc": 0.55, "ret": 0.02, "sharpe": 0.5, "win_rate": 0.52}


def learn(runs: DataFrame) -> DataFrame:
    """Runs with `success`."""
    ok = F.lit(True)
    for c, least in SUCCESS.items():
        ok = ok & (F.col(c) >= least)
    return runs.withColumn("success", F.coalesce(ok, F.lit(False)))


def synergies(runs: DataFrame, least_auc: float = 0.6, least_runs: int = 2) -> DataFrame:
    """Pairs of features used together in good runs: how often, and their mean AUC."""
    good = runs.where(F.col("auc") > least_auc).select("run_id", "auc", F.explode(F.array_distinct("features")).alias("a"))
    pairs = good.join(good.select("run_id", F.col("a").alias("b")), "run_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("auc").alias("mean_auc")).where(F.col("n") > least_runs)


def model_scores(runs: DataFrame, last: int = 50) -> DataFrame:
    """Per model: its AUCs' mean over the last runs, weighted from 1 to e by age."""
    w = Window.partitionBy("model").orderBy(F.desc("run_id"))
    runs = runs.withColumn("_age", F.row_number().over(w)).where(F.col("_age") <= last)
    n = F.count("*").over(Window.partitionBy("model"))
    runs = runs.withColumn("_w", F.exp(F.when(n > 1, (n - F.col("_age")) / (n - 1)).otherwise(0.0)))
    return runs.groupBy("model").agg((F.sum(F.col("_w") * F.col("auc")) / F.sum("_w")).alias("score"))


def preferred_features(runs: DataFrame, k: int = 3) -> DataFrame:
    """The features of successful runs, most used first, in each regime."""
    used = learn(runs).where("success").select("regime", F.explode("features").alias("feature")).groupBy("regime", "feature").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("regime").orderBy(F.desc("n"), "feature"))
    return used.withColumn("place", place).where(F.col("place") <= k)


def untried(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidate (label, model) pairs that no run has failed with."""
    failed = learn(runs).where("not success").select("label", "model").distinct()
    return candidates.join(failed, ["label", "model"], "left_anti")


def best_models(runs: DataFrame) -> DataFrame:
    """Each label's run with the best weighted score; few trades count less."""
    score = (0.3 * F.col("auc") + 0.4 * (F.col("ret") + 1) + 0.2 * (F.col("sharpe") + 1) + 0.1 * F.col("win_rate")) * F.least(F.lit(1.0), F.col("trades") / 10)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "run_id"))
    return runs.withColumn("score", score).withColumn("_p", place).where("_p = 1").select("label", "run_id", "model", "score")


def compare(runs: DataFrame) -> DataFrame:
    """Per model: runs, means and deviations of its metrics, and the economic score."""
    economic = 0.3 * F.col("ret") + 0.25 * F.col("sharpe") + 0.25 * F.col("win_rate") + 0.2 * F.col("auc")
    return runs.groupBy("model").agg(
        F.count("*").alias("n"), F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("std_auc"), F.avg("ret").alias("mean_ret"), F.avg(economic).alias("economic"), F.max_by("label", F.struct("auc", "run_id")).alias("best_label")
    )


def common_features(runs: DataFrame, k: int = 15) -> DataFrame:
    return runs.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(k)


def regime_preferences(runs: DataFrame) -> DataFrame:
    """(regime, feature, preference): a tenth for each successful run with the feature."""
    used = learn(runs).where("success").select("regime", F.explode(F.array_distinct("features")).alias("feature"))
    return used.groupBy("regime", "feature").agg((F.count("*") * 0.1).alias("preference"))


# How much a regime calls for trying new things, and the selection method it prefers.
EXPLORATION = {"CRISIS": 0.8, "SIDEWAYS_LOW_VOL": 0.3, "RECOVERY": 0.3}
METHODS = {
    "CRISIS": "statistical", "BULL_HIGH_VOL": "mutual_info", "BULL_LOW_VOL": "mutual_info", "BEAR_HIGH_VOL": "correlation_analysis", "BEAR_LOW_VOL": "correlation_analysis",
    "SIDEWAYS_HIGH_VOL": "random_forest", "SIDEWAYS_LOW_VOL": "synergy_based", "RECOVERY": "mutual_info",
}


def strategy(profile: DataFrame) -> DataFrame:
    """Priority of each event (closeness to 15 percent frequency .4, quality .3, number of events .3), its place and
    share of the time: the first places get up to twice as much. profile has one row an event."""
    near = 1 - F.abs(F.col("frequency") - 0.15)
    priority = 0.4 * near + 0.3 * F.col("quality") + 0.3 * F.least(F.col("events") / 100, F.lit(1.0))
    df = profile.withColumn("priority", priority).withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "event")))
    total = df.agg(F.count("*").alias("_n"))
    weight = 1 + (F.col("_n") - F.col("place") + 1) / F.col("_n")
    df = df.join(F.broadcast(total)).withColumn("_w", weight)
    whole = df.agg(F.sum("_w").alias("_all"))
    return df.join(F.broadcast(whole)).withColumn("time_share", F.col("_w") / F.col("_all")).drop("_n", "_w", "_all")


def report(runs: DataFrame) -> str:
    """A text summary; one line a model."""
    lines = ["model, runs, mean AUC, mean return, economic score"]
    lines += [f"{r.model}, {r.n}, {r.mean_auc:.3f}, {r.mean_ret:.4f}, {r.economic:.3f}" for r in compare(runs).orderBy(F.desc("economic"), "model").collect()]
    return "\n".join(lines)
