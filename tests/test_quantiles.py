"""Quantiles, ranks and neighbour information beside numpy and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, neighbours, quantiles, scoring

PROBS = [0.0, 0.1, 0.25, 0.5, 0.875, 1.0]


def _groups():
    r = random.Random(9)
    return {
        "even": [float(i) for i in range(500)], "ties": [float(r.randrange(3)) for _ in range(400)], "one": [4.5], "same": [7.0] * 50, "huge": [r.choice([-1.7e308, 1.7e308, 0.0, 1.0]) for _ in range(60)],
        "tails": [math.exp(r.gauss(0, 9)) for _ in range(300)] + [1e15], "signs": [0.0, -0.0, -1.0, 1.0] * 5, "small": [5e-324, 0.0, 1e-320, 3e-310],
    }


@pytest.mark.parametrize("bins", [2, 1024])
def test_quantiles(spark, bins):
    rows = [(k, x) for k, v in _groups().items() for x in v] + [("even", None), ("ties", float("nan")), ("void", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r.quantiles for r in quantiles.quantiles(df, ["k"], "x", PROBS, bins=bins).collect()}
    assert got.keys() == _groups().keys()
    want = {r.k: r.q for r in df.where("not isnan(x)").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    for k, q in got.items():
        assert q == pytest.approx(want[k], rel=1e-12, abs=0), k
    assert quantiles.quantiles(df.limit(0), ["k"], "x", PROBS).count() == 0


def test_order_statistics_of_two_keys(spark):
    r = random.Random(2)
    rows = [(r.randrange(4), r.randrange(3), float(r.randrange(10**6))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, _x double")
    wanted = spark.createDataFrame([(a, b, k) for a in range(4) for b in range(3) for k in (0, 7, 150)], "a int, b int, _rank long")
    for x in quantiles.order_statistics(df, ["a", "b"], wanted, bins=16).collect():
        assert x._value == sorted(v for a, b, v in rows if (a, b) == (x.a, x.b))[x._rank]


def _mi(x, y, k):
    """The estimator on plain arrays."""
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    many = {c: sum(v == c for v in y) for c in set(y)}
    keep = [i for i in range(len(x)) if many[y[i]] > 1]
    total = 0.0
    for i in keep:
        kk = min(k, many[y[i]] - 1)
        r = sorted(abs(x[j] - x[i]) for j in keep if y[j] == y[i] and j != i)[kk - 1]
        m = sum(x[j] == x[i] if r == 0 else x[i] - r < x[j] < x[i] + r for j in keep)
        total += psi(kk) - psi(many[y[i]]) - psi(m)
    return max(0.0, psi(len(keep)) + total / len(keep))


@pytest.mark.parametrize("size", [4, 65_536])
def test_neighbour_information(spark, monkeypatch, size):
    """Ties, tight groups, a class of one, blocks hardly longer than k, and a feature that says nothing."""
    whole = neighbours.radii
    monkeypatch.setattr(neighbours, "radii", lambda rows, k: whole(rows, k, size))
    r = random.Random(6)
    y = [r.randrange(3) for _ in range(240)] + [9]
    f = {"told": [c + r.gauss(0, 0.3) for c in y], "noise": [r.gauss(0, 1) for _ in y], "ties": [float(r.randrange(4)) + (c == 1) for c in y], "flat": [2.0] * len(y)}
    df = spark.createDataFrame([(None, None, c, *(float(f[n][i]) for n in f)) for i, c in enumerate(y)], "symbol string, ts timestamp, y int, " + ", ".join(f"{n} double" for n in f))
    extra = df.limit(1).select("symbol", "ts", F.lit(None).cast("int").alias("y"), *[F.lit(1.0).alias(n) for n in f]).union(df.limit(1).select("symbol", "ts", "y", *[F.lit(None).cast("double").alias(n) for n in f]))
    got = {x.feature: x.mi for x in neighbours.mutual_information_knn(df.union(extra), list(f), 3, parts=8).collect()}
    assert got.keys() == f.keys()
    for n in f:
        assert got[n] == pytest.approx(_mi(f[n], y, 3), abs=1e-9)
    assert got["told"] > 0.5 and got["noise"] < 0.2


def test_digamma(spark):
    got = spark.range(1, 300).select("id", neighbours.digamma(F.col("id").cast("double")).alias("p")).collect()
    assert all(r.p == pytest.approx(-0.5772156649015329 + sum(1 / i for i in range(1, r.id)), abs=1e-12) for r in got)


def test_medians_of_operators(spark):
    r = random.Random(3)
    rows = [("A", None, i, r.gauss(10, 1) if i % 50 else 99.0) for i in range(1, 400)] + [("B", None, 1, 5.0), ("C", None, 1, None)]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double")
    a = np.array([p for s, _, _, p in rows if s == "A"])
    far = np.abs(a - np.median(a))
    got = {(x.symbol, x.seq): x.outlier for x in bars.mad_outliers(t).collect()}
    assert len(got) == len(rows) and all(got["A", i + 1] == (0.6745 * d / np.median(far) > 3) for i, d in enumerate(far)) and not got["B", 1] and not got["C", 1]
    df = spark.createDataFrame([("A", None, None, 1.0), ("B", None, 4.0, 2.0), ("C", None, 6.0, None)], "symbol string, ts timestamp, f double, g double")
    filled = {x.symbol: (x.f, x.g) for x in scoring.fill(df, ["f", "g"]).collect()}
    assert filled == {"A": (5.0, 1.0), "B": (4.0, 2.0), "C": (6.0, 1.5)}
