"""Model zoo, ordered cross-validation, importances and genetic selection with pyspark.ml."""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scoring, trees
from tidemark.operators.moments import SharedFolds
from tidemark.operators.neighbour_join import nearest
from tidemark.storage import store

ZOO: dict[str, Callable] = {
    "logistic": lambda: LogisticRegression(maxIter=30, labelCol="y"),
    "random_forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=6, seed=42, labelCol="y"),
    "gradient_boosting": lambda: GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.1, seed=42, labelCol="y"),
    "decision_tree": lambda: DecisionTreeClassifier(maxDepth=6, seed=42, labelCol="y"),
    "naive_bayes": lambda: NaiveBayes(modelType="gaussian", labelCol="y"),
    "linear_svm": lambda: LinearSVC(maxIter=20, labelCol="y"),
}


def _pipeline(columns: list[str], model) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), model])


def _moments(train: DataFrame, columns: list[str]) -> tuple[dict[int, float], dict[int, np.ndarray], np.ndarray]:
    """Rows and column means by class, and the pooled covariance, from one pass of sums."""
    x = [F.col(c).cast("double") for c in columns]
    cross = [F.sum(a * b).alias(f"c{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    rows = train.groupBy(F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{i}") for i, a in enumerate(x)], *cross).collect()
    d = len(columns)
    n = {r.y: float(r.n) for r in rows}
    mean = {r.y: np.array([r[f"s{i}"] for i in range(d)]) / r.n for r in rows}
    pooled = np.zeros((d, d))
    for r in rows:
        for i in range(d):
            for j in range(i, d):
                v = r[f"c{i}_{j}"] - r.n * mean[r.y][i] * mean[r.y][j]
                pooled[i, j] += v
                if i != j:
                    pooled[j, i] += v
    return n, mean, pooled


def lda(train: DataFrame, columns: list[str]) -> tuple[np.ndarray, float]:
    """Linear discriminant: weights and intercept of the log odds of class 1."""
    n, mean, pooled = _moments(train, columns)
    if len(n) < 2:
        return np.zeros(len(columns)), 0.0
    total = sum(n.values())
    w = np.linalg.lstsq(pooled / max(total - 2, 1), mean[1] - mean[0], rcond=None)[0]
    return w, float(np.log(n[1] / n[0]) - w @ (mean[0] + mean[1]) / 2)


def ridge(train: DataFrame, columns: list[str], alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge regression of -1 and 1 on scaled columns; the sign of its value is the class."""
    n, mean, pooled = _moments(train, columns)
    if len(n) < 2:
        return np.zeros(len(columns)), 0.0
    total = sum(n.values())
    mid = sum(n[k] * mean[k] for k in n) / total
    cov = pooled + sum(n[k] * np.outer(mean[k] - mid, mean[k] - mid) for k in n)
    scale = np.sqrt(np.maximum(np.diag(cov) / total, 1e-300))
    ym = (n[1] - n[0]) / total
    xy = sum(n[k] * (mean[k] - mid) * ((2 * k - 1) - ym) for k in n) / scale
    w = np.linalg.solve(cov / np.outer(scale, scale) + alpha * np.eye(len(columns)), xy) / scale
    return w, float(ym - w @ mid)


CLOSED = {"lda": lda, "ridge": ridge}


def _scaled(train: DataFrame, columns: list[str]) -> Column:
    """The columns as an array, less their training means and over their deviations; constant columns are zero."""
    r = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    part = lambda i, c: (F.col(c).cast("double") - r[f"m{i}"]) / r[f"s{i}"] if r[f"s{i}"] else F.lit(0.0)
    return F.array(*[part(i, c) for i, c in enumerate(columns)])


def knn(train: DataFrame, test: DataFrame, columns: list[str], k: int = 7) -> DataFrame:
    """`score`: the share of class 1 among the k nearest training rows in scaled columns, exactly. Rows have symbol and ts, by
    whose hash equal distances are ordered, and no nulls in the columns."""
    x = _scaled(train, columns)
    rows = store(test.withColumn("_q", F.monotonically_increasing_id()))
    points = train.select(F.xxhash64("symbol", "ts").alias("order"), x.alias("x"), F.col("y").cast("int").alias("y"))
    near = nearest(rows.select(F.col("_q").alias("q"), x.alias("x")), points, k).select(F.col("q").alias("_q"), (F.size(F.filter("near", lambda s: s["y"] == 1)) / F.size("near")).alias("score"))
    return rows.join(near, "_q").drop("_q").withColumn("pred", (F.col("score") > 0.5).cast("int"))


def extra_trees(train: DataFrame, test: DataFrame, columns: list[str], **options) -> DataFrame:
    out = trees.scored(test, columns, *trees.extra_trees(train, columns, **options))
    return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def boosted(train: DataFrame, test: DataFrame, columns: list[str], **options) -> DataFrame:
    out = trees.scored(test, columns, *trees.boosted(train, columns, **options))
    return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def rbf_svm(train: DataFrame, test: DataFrame, columns: list[str], wide: int = 200, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """A linear support vector machine on random Fourier features of the scaled columns, whose products approach the kernel
    exp(-gamma |a - b|^2); gamma is 1 / columns unless given."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, (2 * (gamma or 1 / len(columns))) ** 0.5, (len(columns), wide))
    shift = rng.uniform(0, 2 * np.pi, wide)
    x = _scaled(train, columns)

    def features(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.cos(np.stack(v.to_numpy()) @ w + shift) * (2 / wide) ** 0.5)) if len(v) else v

    wave = F.pandas_udf(features, "array<double>")
    df = lambda d: d.withColumn("features", array_to_vector(wave(x)))
    fit = LinearSVC(maxIter=50, regParam=1e-4, labelCol="y").fit(df(train.withColumn("y", F.col("y").cast("double"))).select("features", "y"))
    t = fit.transform(df(test))
    return t.select(*test.columns, F.element_at(vector_to_array("rawPrediction"), 2).alias("score"), F.col("prediction").cast("int").alias("pred"))


OWN: dict[str, Callable] = {"knn": knn, "extra_trees": extra_trees, "rbf_svm": rbf_svm, "boosted_trees": boosted}


def scored(train: DataFrame, test: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The test rows with `score` and `pred` of a model fitted on the training rows."""
    if name in OWN:
        return OWN[name](train, test, columns)
    if name in CLOSED:
        w, b = CLOSED[name](train, columns)
        score = sum((F.col(c).cast("double") * float(v) for c, v in zip(columns, w)), F.lit(b))
        return test.withColumn("score", score).withColumn("pred", (F.col("score") > 0).cast("int"))
    t = _pipeline(columns, ZOO[name]()).fit(train).transform(test)
    score = F.element_at(vector_to_array("probability" if "probability" in t.columns else "rawPrediction"), 2)
    return t.select(*test.columns, score.alias("score"), F.col("prediction").cast("int").alias("pred"))


def cross_validate(df: DataFrame, columns: list[str], names: list[str], k: int = 3, threads: int = 4) -> DataFrame:
    """(model, auc, accuracy, precision, recall, f1 and their deviations), over expanding ordered folds; fits run side by side.
    Rows, folds and scored rows are stored: each is read several times, and every pass would otherwise compute it anew."""
    rows = store(df.select("symbol", "ts", *columns, F.col("y").cast("double").alias("y")))
    placed = store(scoring.folds(rows, k))
    part = lambda i, role: placed.where((F.col("fold") == i) & (F.col("role") == role))

    def job(at: tuple[str, int]) -> DataFrame:
        name, i = at
        out = scored(part(i, "train"), part(i, "test"), columns, name)
        return out.select(F.lit(name).alias("model"), F.lit(i).alias("fold"), "score", "pred", F.col("y").cast("int").alias("y"))

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(job, [(n, i) for n in names for i in range(k)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out, by, metrics = store(out), ["model", "fold"], ("auc", "accuracy", "precision", "recall", "f1")
    m = scoring.auc(out, by).join(scoring.confusion(out, by), by)
    m = m.groupBy("model").agg(*[F.avg(c).alias(c) for c in metrics], *[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"{c}_std") for c in metrics])
    return m.sparkSession.createDataFrame(m.collect(), m.schema)  # one row a model


def holdout_economics(df: DataFrame, columns: list[str], names: list[str], share: float = 0.7) -> DataFrame:
    """Per model: return, Sharpe, win rate over all rows and trades on the last rows, fitted on the first `share`."""
    placed = scoring.split(df.select("symbol", "ts", *columns, "ret", F.col("y").cast("double").alias("y")), share)
    train, test = placed.where("role = 'train'"), placed.where("role = 'test'")
    out = None
    for name in names:
        g = F.when(F.col("pred") == 1, F.coalesce("ret", F.lit(0.0))).otherwise(0.0)
        row = scored(train, test, columns, name).agg(
            F.lit(name).alias("model"), F.sum(g).alias("ret"), F.coalesce(F.try_divide(F.avg(g), F.nullif(F.stddev_samp(g), F.lit(0.0))) * 252**0.5, F.lit(0.0)).alias("sharpe"),
            F.avg((g > 0).cast("double")).alias("win_rate"), F.count_if(g != 0).alias("trades"),
        )
        out = row if out is None else out.union(row)
    return out


def genetic_selection(df: DataFrame, columns: list[str], model: str = "lda", k: int = 2, **options) -> list[str]:
    """select_genetic with the mean AUC of ordered folds as fitness. The closed-form models share the folds' moments: a
    generation is one job, whatever the population; others are fitted mask by mask."""
    if model in CLOSED:
        folds = SharedFolds(df, columns, k)
        return select_genetic(columns, lambda masks: folds.aucs(masks, model), **options)
    return select_genetic(columns, lambda masks: [cross_validate(df, list(m), [model], k).first()["auc"] or 0.0 for m in masks], **options)


def importances(df: DataFrame, columns: list[str], name: str = "random_forest") -> DataFrame:
    fit = _pipeline(columns, ZOO[name]()).fit(df.select(*columns, F.col("y").cast("double").alias("y")))
    v = fit.stages[-1].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(columns, v)), "feature string, score double")


def select_genetic(columns: list[str], fitness: Callable[[list[tuple[str, ...]]], list[float]], population: int = 20, generations: int = 10, mutation: float = 0.15, crossover: float = 0.8, tournament: int = 3, patience: int = 5, least: int = 3, seed: int = 42) -> list[str]:
    """Columns of the fittest mask: tournaments, two-point crossover, bit flips, one survivor a generation. fitness gets all
    column sets of a generation that it hasn't seen."""
    rng, n = random.Random(seed), len(columns)

    def mend(mask: list[bool]) -> tuple[bool, ...]:
        off = [i for i, b in enumerate(mask) if not b]
        rng.shuffle(off)
        for i in off[: max(0, min(least, n) - sum(mask))]:
            mask[i] = True
        return tuple(mask)

    known: dict[tuple[bool, ...], float] = {}

    def learn(masks: list[tuple[bool, ...]]) -> None:
        new = [m for m in dict.fromkeys(masks) if m not in known]
        for m, f in zip(new, fitness([tuple(c for c, b in zip(columns, m) if b) for m in new]) if new else ()):
            share = sum(m) / n
            known[m] = f - 0.05 * share + (0.01 if share <= 0.3 else 0.0)

    worth = known.__getitem__
    now, best, still = [mend([rng.random() < 0.4 for _ in range(n)]) for _ in range(population)], None, 0
    for _ in range(generations):
        learn(now)
        ranked = sorted(now, key=worth, reverse=True)
        if best is None or worth(ranked[0]) > worth(best) + 1e-9:
            best, still = ranked[0], 0
        else:
            still += 1
            if still >= patience:
                break
        pick = lambda: max(rng.sample(now, min(tournament, len(now))), key=worth)
        new = [ranked[0]]
        while len(new) < population:
            a, b = list(pick()), list(pick())
            if rng.random() < crossover and n > 2:
                i, j = sorted(rng.sample(range(n), 2))
                a[i:j] = b[i:j]
            new.append(mend([(not x) if rng.random() < mutation else x for x in a]))
        now = new
    return [c for c, b in zip(columns, best or now[0]) if b]
