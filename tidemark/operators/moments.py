"""Many small models from few passes: moments of ordered folds shared by all column masks, and all one-column logits at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.storage import store


class Moments:
    """Rows, sums and cross products by class, of columns that were shifted and scaled."""

    def __init__(self, width: int):
        self.n, self.s, self.c = {}, {}, {}
        self.width = width

    def add(self, y: int, flat: np.ndarray) -> None:
        """flat: rows, sums, cross products in a row."""
        d = self.width
        self.n[y] = self.n.get(y, 0.0) + flat[0]
        self.s[y] = self.s.get(y, 0.0) + flat[1 : d + 1]
        self.c[y] = self.c.get(y, 0.0) + flat[d + 1 :].reshape(d, d)

    def lda(self, mask: Sequence[int]) -> np.ndarray:
        """Weights of the linear discriminant on the masked columns, zero elsewhere."""
        out, at = np.zeros(self.width), np.array(mask)
        if len(self.n) < 2:
            return out
        mean = {y: self.s[y][at] / self.n[y] for y in self.n}
        pooled = sum(self.c[y][np.ix_(at, at)] - self.n[y] * np.outer(mean[y], mean[y]) for y in self.n)
        out[at] = np.linalg.lstsq(pooled / max(sum(self.n.values()) - 2, 1), mean[1] - mean[0], rcond=None)[0]
        return out

    def ridge(self, mask: Sequence[int], alpha: float = 1.0) -> np.ndarray:
        """Weights of the ridge regression of -1 and 1 on the masked columns, scaled by their training deviation."""
        out, at = np.zeros(self.width), np.array(mask)
        if len(self.n) < 2:
            return out
        total = sum(self.n.values())
        mid = sum(self.s[y][at] for y in self.n) / total
        cov = sum(self.c[y][np.ix_(at, at)] for y in self.n) - total * np.outer(mid, mid)
        scale = np.sqrt(np.maximum(np.diag(cov) / total, 1e-300))
        ym = (self.n[1] - self.n[0]) / total
        xy = sum((2 * y - 1 - ym) * (self.s[y][at] - self.n[y] * mid) for y in self.n) / scale
        out[at] = np.linalg.solve(cov / np.outer(scale, scale) + alpha * np.eye(len(at)), xy) / scale
        return out


def _sums(width: int):
    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x = np.stack([b.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(width)], 1)
            key = np.stack([b.column("seg").to_numpy(), b.column("y").to_numpy()], 1)
            for seg, y in np.unique(key, axis=0).tolist():
                v = x[(key == (seg, y)).all(axis=1)]
                flat = np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
                total[seg, y] = total.get((seg, y), 0.0) + flat
        for (seg, y), flat in total.items():
            n = len(flat)
            yield pa.record_batch({"seg": pa.array([seg] * n), "y": pa.array([y] * n), "at": pa.array(np.arange(n)), "v": pa.array(flat)})

    return run


class SharedFolds:
    """Expanding ordered folds of rows (symbol, ts, columns, y of 0 or 1) whose segments' moments are summed in one pass, so that a
    closed-form model on any columns costs a small solve for each fold; scores of any number of masks take one job."""

    def __init__(self, df: DataFrame, columns: list[str], k: int = 3):
        self.columns, self.k = columns, k
        rows = scoring.numbered(df.select("symbol", "ts", *columns, F.col("y").cast("long").alias("y")), ("ts", "symbol"))
        one = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        r = rows.agg(F.count("*").alias("n"), *one).first()
        part = r.n // (k + 1)
        base = r.n - k * part
        seg = F.when(F.col("rn") <= base, 0).otherwise(1 + F.floor((F.col("rn") - base - 1) / max(part, 1))).cast("long")
        x = [((F.col(c).cast("double") - (r[f"m{i}"] or 0.0)) / (r[f"s{i}"] or 1.0)).alias(f"x{i}") for i, c in enumerate(columns)]
        self.rows = store(rows.select(seg.alias("seg"), "y", *x))
        self.train = [Moments(len(columns)) for _ in range(k)]
        sums = self.rows.mapInArrow(_sums(len(columns)), "seg long, y long, at long, v double").groupBy("seg", "y", "at").agg(F.sum("v").alias("v"))
        flat: dict[tuple[int, int], np.ndarray] = {}
        for s in sums.collect():  # (k + 1) * 2 * (1 + columns + columns ** 2) numbers
            flat.setdefault((s.seg, s.y), np.zeros(1 + len(columns) + len(columns) ** 2))[s.at] = s.v
        for (s, y), v in flat.items():
            for i in range(s, k):  # fold i trains on segments 0..i and tests on i + 1
                self.train[i].add(y, v)

    def aucs(self, masks: list[tuple[str, ...]], model: str = "lda") -> list[float]:
        """Each mask's mean AUC over the folds; folds whose test part has one class don't count, and 0.0 if none does."""
        place = {c: i for i, c in enumerate(self.columns)}
        fit = lambda i, m: getattr(self.train[i], model)([place[c] for c in m])
        weights = np.stack([[fit(i, m) for m in masks] for i in range(self.k)])  # fold, mask, column
        width, many = len(self.columns), len(masks)

        def run(batches):
            for b in batches:
                x = np.stack([b.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(width)], 1)
                seg, y = b.column("seg").to_numpy(), b.column("y").to_numpy()
                for s in np.unique(seg):
                    v = x[seg == s] @ weights[s - 1].T
                    n = len(v)
                    yield pa.record_batch({"mask": pa.array(np.repeat(np.arange(many), n)), "fold": pa.array(np.full(many * n, s - 1)), "score": pa.array(v.T.ravel()), "y": pa.array(np.tile(y[seg == s], many))})

        scores = self.rows.where("seg > 0").mapInArrow(run, "mask long, fold long, score double, y long")
        found = scoring.auc(scores, ["mask", "fold"]).groupBy("mask").agg(F.avg("auc").alias("auc")).collect()  # one row a mask
        out = {r.mask: r.auc for r in found}
        return [out.get(i) or 0.0 for i in range(many)]


def logistic_singles(rows: DataFrame, by: list[str], steps: int = 25, tolerance: float = 1e-8) -> dict[tuple, tuple[float, float]]:
    """Intercept and slope of a logistic regression of y on x alone, for every key at once: each Newton step is one sum over
    all rows (by, x, y). Keys of one class or without spread get their log odds (within 1e-6 of certain) and no slope."""
    stats = rows.groupBy(*by).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.avg("y").alias("p")).collect()  # one row a key
    odds = lambda p: float(np.log(p / (1 - p)))
    now = {tuple(r[c] for c in by): [odds(min(max(r.p, 1e-6), 1 - 1e-6)), 0.0, r.m, r.s or 0.0] for r in stats}
    open_ = {tuple(r[c] for c in by) for r in stats if r.s and 0 < r.p < 1}
    spark, kinds = rows.sparkSession, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    for _ in range(steps):
        if not open_:
            break
        told = spark.createDataFrame([(*k, *map(float, now[k])) for k in sorted(open_)], f"{kinds}, a double, b double, m double, s double")
        z = (F.col("x") - F.col("m")) / F.col("s")
        p = F.col("p")
        moved = rows.join(F.broadcast(told), by).withColumn("z", z).withColumn("p", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("z")))))  # one row a key
        total: dict[str, Column] = {"g0": F.col("y") - p, "g1": (F.col("y") - p) * F.col("z"), "h00": p * (1 - p), "h01": p * (1 - p) * F.col("z"), "h11": p * (1 - p) * F.col("z") * F.col("z")}
        for r in moved.groupBy(*by).agg(*[F.sum(v).alias(c) for c, v in total.items()]).collect():
            key = tuple(r[c] for c in by)
            h = np.array([[r.h00, r.h01], [r.h01, r.h11]]) + 1e-9 * np.eye(2)
            step = np.clip(np.linalg.solve(h, [r.g0, r.g1]), -4, 4)
            now[key][0], now[key][1] = now[key][0] + float(step[0]), now[key][1] + float(step[1])
            if np.abs(step).max() < tolerance or max(abs(now[key][0]), abs(now[key][1])) > 30:
                open_.discard(key)
    return {k: (a - b * m / s, b / s) if s else (a, 0.0) for k, (a, b, m, s) in now.items()}
