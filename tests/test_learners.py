"""The zoo's own models: exact neighbours, random-threshold trees, boosting and the kernel machine."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, trees
from tidemark.operators.neighbour_join import nearest

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("blocks", [(4096, 1024), (40, 15)])
@pytest.mark.parametrize("shape", ["cloud", "copies", "line"])
def test_nearest(spark, shape, blocks):
    """Brute force on a cloud, on a few places that many points share, and on points far apart on a line."""
    r = random.Random(1)
    place = {"cloud": lambda: [r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)], "copies": lambda: [float(r.randrange(2)), 0.0, float(r.randrange(2))], "line": lambda: [math.exp(r.uniform(0, 20)), 0.0, 0.0]}[shape]
    points = [(i * 7 - 50, place(), r.randrange(2)) for i in range(500)]
    queries = [(i, place()) for i in range(60)] + [(99, [1e6, 1e6, 1e6])]
    p = spark.createDataFrame(points, "order long, x array<double>, y int")
    q = spark.createDataFrame(queries, "q long, x array<double>")
    got = {x.q: [(n.d, n.order, n.y) for n in x.near] for x in nearest(q, p, 7, points_block=blocks[0], queries_block=blocks[1]).collect()}
    for i, x in queries:
        want = sorted((sum((a - b) ** 2 for a, b in zip(x, z)), o, y) for o, z, y in points)[:7]
        assert [(o, y) for _, o, y in got[i]] == [(o, y) for _, o, y in want] and [d for d, *_ in got[i]] == pytest.approx([d for d, *_ in want])
    few = nearest(q, p.limit(3), 7).collect()
    assert len(few) == len(queries) and all(len(x.near) == 3 for x in few)
    assert all(x.near == [] for x in nearest(q, p.limit(0), 7).collect())


def test_pairs_are_few(spark):
    """Queries visit a small share of the points where pivots tell them apart."""
    r = random.Random(2)
    centres = [(100.0 * i, 50.0 * (i % 3)) for i in range(20)]
    rows = [(i, [c + r.gauss(0, 1) for c in centres[i % 20]], i % 2) for i in range(2000)]
    p = spark.createDataFrame(rows, "order long, x array<double>, y int")
    seen = spark.sparkContext.accumulator(0)
    from tidemark.operators import neighbour_join as J

    plain = J._candidates

    def counted(k):
        f = plain(k)

        def run(key, a, b):
            seen.add(len(a) * len(b))
            return f(key, a, b)

        return run

    J._candidates = counted
    try:
        nearest(p.select(F.col("order").alias("q"), "x"), p, 5).collect()
    finally:
        J._candidates = plain
    assert 0 < seen.value < 0.25 * 2000**2


@pytest.fixture(scope="module")
def rings(spark):
    """Class 1 inside a ring of class 0, a column of noise and a constant one."""
    r, rows = random.Random(3), []
    for i in range(900):
        a, y = r.uniform(0, 2 * math.pi), i % 2
        d = r.uniform(0, 1) if y else r.uniform(1.5, 2.5)
        rows.append(("A", T0 + dt.timedelta(minutes=i), d * math.cos(a), d * math.sin(a), r.gauss(0, 1), 5.0, y))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, f double, g double, noise double, flat double, y int")
    return df.where("minute(ts) % 3 > 0").cache(), df.where("minute(ts) % 3 = 0").cache()


@pytest.mark.parametrize("name", ["knn", "extra_trees", "boosted_trees", "rbf_svm"])
def test_rings(rings, name):
    train, test = rings
    columns = ["f", "g", "noise", "flat"] if name != "knn" else ["f", "g"]
    out = models.scored(train, test, columns, name).collect()
    assert out[0].__fields__ == [*test.columns, "score", "pred"] and len(out) == test.count()
    assert np.mean([x.pred == x.y for x in out]) > 0.9
    if name == "rbf_svm":
        plain = models.scored(train, test, columns, "linear_svm").collect()
        assert np.mean([x.pred == x.y for x in plain]) < 0.75


def test_trees_are_seeded_and_pure(rings):
    train, _ = rings
    columns = ["f", "g", "noise", "flat"]
    one, cuts = trees.extra_trees(train, columns, trees=5, depth=4)
    again, _ = trees.extra_trees(train.repartition(7), columns, trees=5, depth=4)
    other, _ = trees.extra_trees(train, columns, trees=5, depth=4, seed=1)
    told = lambda f: [(t.feature, t.cut, t.value) for t in f]
    assert told(one) == told(again) != told(other)
    x = train.select(*columns, F.col("y").cast("double").alias("y")).toArrow().combine_chunks().to_batches()[0]
    codes, y = trees._codes(x, columns, cuts), x.column("y").to_numpy()
    assert 3 not in {f for t in one for f in t.feature}  # a constant column is never split
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0
    for t in one:
        at, all_ = t.leaf(codes), gini(y)
        assert sum(gini(y[at == n]) for n in set(at)) < all_
        for n in set(at):
            assert t.value[n] == pytest.approx(y[at == n].mean()) and t.depth[n] <= 4


def test_boosting_steps(rings):
    """Leaf values are -rate * G / (H + ridge) of their rows, leaves and depth are bounded, and the loss falls with each tree."""
    train, _ = rings
    columns = ["f", "g", "noise"]
    made, cuts, first = trees.boosted(train, columns, rounds=4, leaves=6, depth=3)
    x = train.select(*columns, F.col("y").cast("double").alias("y")).toArrow().combine_chunks().to_batches()[0]
    codes, y = trees._codes(x, columns, cuts), x.column("y").to_numpy()
    odds, loss = np.full(len(y), first), []
    for t in made:
        p = 1 / (1 + np.exp(-odds))
        loss.append(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))
        at = t.leaf(codes)
        assert len(set(at)) <= 6 and max(t.depth) <= 3
        for n in set(at):
            g, h = (p - y)[at == n].sum(), (p * (1 - p))[at == n].sum()
            assert t.value[n] == pytest.approx(-0.1 * g / (h + 1.0), rel=1e-6)
        odds = odds + t.values(codes)
    assert len(made) == 4 and loss == sorted(loss, reverse=True)


def test_one_class_and_nulls(spark):
    rows = [("A", T0 + dt.timedelta(minutes=i), float(i) if i % 5 else None, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, f double, y int")
    for name in ("extra_trees", "boosted_trees"):
        assert {x.pred for x in models.scored(df, df, ["f"], name).collect()} == {1}


def test_nearest_over_many_partitions(spark):
    """Queries meet their points where the pairs of blocks lie in several shuffle partitions, and blocks may be without points."""
    r = random.Random(3)
    points = [(i, [r.gauss(0, 1), r.gauss(0, 1)], i % 2) for i in range(400)]
    p = spark.createDataFrame(points, "order long, x array<double>, y int")
    q = p.select((F.col("order") * 3).alias("q"), "x")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {x.q: [n.order for n in x.near] for x in nearest(q, p, 3, points_block=4, queries_block=4).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == {3 * i: [o for _, o in sorted((math.dist(x, z), o) for o, z, _ in points)[:3]] for i, x, _ in points}


def test_cross_validation_reads_its_rows_once(spark):
    r, seen = random.Random(4), spark.sparkContext.accumulator(0)

    def told(v):
        seen.add(1)
        return True

    rows = [("A", T0 + dt.timedelta(hours=i), r.gauss(0, 1), r.randrange(2)) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, f double, y int").where(F.udf(told, "boolean")("f"))
    assert models.cross_validate(df, ["f"], ["lda", "ridge"], 2).count() == 2 and seen.value == len(rows)


def test_plans_do_not_grow_with_the_pivots(spark, monkeypatch):
    """The driver's memory: a plan held an expression for each pivot and coordinate, in every place that read its distance."""
    from tidemark.operators import neighbour_join as J

    r, plain, sizes = random.Random(5), J.store, {}
    p = spark.createDataFrame([(i, [r.gauss(0, 1), r.gauss(0, 1)], i % 2) for i in range(400)], "order long, x array<double>, y int")
    for pivots in (2, 20):
        sizes[pivots] = []
        monkeypatch.setattr(J, "store", lambda df: sizes[pivots].append(len(df._jdf.queryExecution().analyzed().toString())) or plain(df))  # noqa: B023
        nearest(p.select(F.col("order").alias("q"), "x"), p, 3, pivots)
    assert len(sizes[2]) == len(sizes[20]) and max(b / a for a, b in zip(sizes[2], sizes[20])) < 1.5
