"""Exact k nearest neighbours of every query among the points of another table, joined by pivots.

Points belong to the nearest of a bounded number of pivots. A pivot with k points or more bounds how far a query's k-th neighbour
can be: the query's distance to the pivot plus the k-th smallest distance of the pivot's points to it. A query goes only to
pivots whose points can lie within its bound, by the triangle inequality. Pivots with many points or
queries are cut into blocks of both, so that no task holds more than two blocks; each pair of blocks keeps k candidates a
query, and these are merged by query. Every query gets its exact neighbours, whatever the data's shape.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.storage import store

PIVOTS, POINTS, QUERIES = 256, 4096, 1024
ROWS = 1024  # queries whose distances to all pivots are held at a time


def _distances(x: pa.ListArray, to: np.ndarray) -> np.ndarray:
    """From each of the rows' points to each of `to`: (row, place)."""
    rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), to.shape[1])
    far = np.zeros((len(rows), len(to)))
    for i in range(to.shape[1]):
        far += np.subtract.outer(rows[:, i], to[:, i]) ** 2
    return np.sqrt(far)


def _owners(pivots: np.ndarray):
    """Each point's nearest pivot, the first of equal ones, and the distance to it."""

    def run(batches):
        for b in batches:
            far = _distances(b.column("x"), pivots)
            at = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64()), pa.array(far[np.arange(len(at)), at])], [*b.schema.names, "pivot", "r"])

    return run


def _visits(pivots: np.ndarray, kth: np.ndarray, reach: np.ndarray):
    """A row for each query and pivot whose points can be among its nearest; `reach` is minus infinity for pivots without points."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                far = _distances(some.column("x"), pivots)
                bound = (far + kth).min(axis=1, keepdims=True)
                query, pivot = np.nonzero((reach > -np.inf) & (far - reach <= bound * (1 + 1e-9) + 1e-12))
                out = some.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(pivot, pa.int64())], [*out.schema.names, "pivot"])

    return run


def _candidates(k: int):
    def run(key: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "d": [], "order": [], "y": []}
        if len(q) and len(p):
            x, z = np.stack(q["x"].to_numpy()).astype(float), np.stack(p["x"].to_numpy()).astype(float)
            far = np.zeros((len(x), len(z)))
            for i in range(x.shape[1]):
                far += np.subtract.outer(x[:, i], z[:, i]) ** 2
            order, y = p["order"].to_numpy(), p["y"].to_numpy()
            for row, at in zip(far, q["q"]):
                near = np.flatnonzero(row <= np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1])
                near = near[np.lexsort((order[near], row[near]))][:k]
                out["q"].append(at)
                out["d"].append(row[near].tolist())
                out["order"].append(order[near].tolist())
                out["y"].append(y[near].tolist())
        return pd.DataFrame(out, dtype=object)  # no rows must still be lists to Arrow

    return run


def nearest(queries: DataFrame, points: DataFrame, k: int, pivots: int = PIVOTS, points_block: int = POINTS, queries_block: int = QUERIES) -> DataFrame:
    """(q, near): for each query (q long, x array<double>) its k nearest points (order, x array<double>, y) as an array of (d,
    order, y), nearest first; d is the squared distance and equal distances go by `order`, a value that tells points apart.
    Fewer than k points give what there is. Coordinates must not be null or NaN."""
    spark = queries.sparkSession
    points = store(points.select("order", "x", "y"))
    n = points.count()
    many = max(1, min(pivots, int(n**0.5)))
    chosen = [r.x for r in points.orderBy(F.xxhash64("order")).select("x").limit(many).collect()]  # at most `pivots`
    if not chosen:
        return queries.select("q", F.array().cast("array<struct<d:double,order:long,y:int>>").alias("near"))
    pivots = np.array(chosen, float)
    points = store(points.mapInArrow(_owners(pivots), StructType([*points.schema.fields, StructField("pivot", LongType()), StructField("r", DoubleType())])))
    stats = points.groupBy("pivot").agg(F.count("*").alias("n"), F.max("r").alias("reach"), F.slice(F.array_sort(F.collect_list("r")), k, 1).alias("kth")) if n <= points_block else _pivot_stats(points, k)
    kth, reach = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for s in stats.collect():  # one row a pivot
        kth[s.pivot], reach[s.pivot] = s.kth[0] if len(s.kth) else np.inf, s.reach
    queries = queries.select("q", "x")
    queries = store(queries.mapInArrow(_visits(pivots, kth, reach), StructType([*queries.schema.fields, StructField("pivot", LongType())])))
    asked = queries.groupBy("pivot").agg(F.count("*").alias("m"))
    blocks = stats.select("pivot", F.ceil(F.col("n") / points_block).alias("a")).join(asked.select("pivot", F.ceil(F.col("m") / queries_block).alias("b")), "pivot")
    blocks = F.broadcast(store(blocks))  # one row a pivot
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    p = points.join(blocks, "pivot").select("pivot", F.pmod(F.xxhash64("order"), "a").alias("i"), every("b").alias("j"), "order", "x", "y")
    q = queries.join(blocks, "pivot").select("pivot", every("a").alias("i"), F.pmod(F.xxhash64("q"), "b").alias("j"), "q", "x")
    key = ["pivot", "i", "j"]
    parts = q.groupBy(*key).cogroup(p.groupBy(*key)).applyInPandas(_candidates(k), "q long, d array<double>, order array<long>, y array<int>")
    one = F.explode(F.arrays_zip("d", "order", "y"))
    parts = parts.select("q", one.alias("c")).groupBy("q").agg(F.slice(F.array_sort(F.collect_list("c")), 1, k).alias("near"))  # k from each pair of blocks
    return parts.select("q", F.col("near").cast("array<struct<d:double,order:long,y:int>>").alias("near"))


def _pivot_stats(points: DataFrame, k: int) -> DataFrame:
    """(pivot, n, reach, kth): the k-th smallest distance from counts of the k smallest of each part of a pivot's points."""
    part = F.pmod(F.xxhash64("order"), F.lit(64))
    first = F.row_number().over(Window.partitionBy("pivot", "part").orderBy("r"))
    small = points.select("pivot", "r", part.alias("part")).withColumn("i", first).where(F.col("i") <= k)
    kth = small.groupBy("pivot").agg(F.slice(F.array_sort(F.collect_list("r")), k, 1).alias("kth"))  # 64 * k at most
    return points.groupBy("pivot").agg(F.count("*").alias("n"), F.max("r").alias("reach")).join(kth, "pivot")
