"""Mutual information of a continuous feature with a class by nearest neighbours.

For each value the distance r to its k-th nearest value of the same class, and the number m of values of all classes that are
nearer than r, give psi(n) + mean psi(k) - mean psi(class size) - mean psi(m). Values in order need only their k
neighbours on each side for r; m is the difference of two ranks. Both come from windows over parts of the
values between exact quantiles, with counts of the parts before, so that a feature's values are never in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import cut_by, quantiles
from tidemark.operators.scoring import long
from tidemark.storage import store

EULER_SHIFT = 10


def digamma(n: Column) -> Column:
    """psi of a positive number: the asymptotic series ten steps higher, brought down by the recurrence."""
    x = n + EULER_SHIFT
    y = 1 / (x * x)
    series = F.ln(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    down = 1 / n
    for i in range(1, EULER_SHIFT):
        down = down + 1 / (n + i)
    return series - down


def _numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with `_rn`, their place by value in their key, counted in parts."""
    parts = rows.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order)) + F.col("_before")
    return rows.join(parts, [*key, "_part"]).withColumn("_rn", place).drop("_before")


def radii(rows: DataFrame, k: int, size: int = 65_536) -> DataFrame:
    """rows (feature, y, x, _part) of classes with two values or more, with `_size` of the class, `_k` and `r`."""
    sizes = rows.groupBy("feature", "y").agg(F.count("*").alias("_size")).where("_size > 1")
    rows = _numbered(rows.join(sizes, ["feature", "y"]), ["feature", "y"], ["x"]).withColumn("_k", F.least(F.lit(k), F.col("_size") - 1).cast("int"))
    own, at = F.expr(f"(_rn - 1) div {size}"), F.expr(f"(_rn - 1) % {size}")
    rows = rows.withColumn("_own", own).withColumn("_blk", F.explode(F.array_compact(F.array(own, F.when(at >= size - k, own + 1), F.when(at < k, own - 1)))))
    w = Window.partitionBy("feature", "y", "_blk").orderBy("_rn")
    near = F.array_sort(F.array_compact(F.array(*[F.abs(f("x", i).over(w) - F.col("x")) for i in range(1, k + 1) for f in (F.lag, F.lead)])))
    return rows.withColumn("r", F.element_at(near, F.col("_k"))).where("_blk = _own").drop("_own", "_blk")


def mutual_information_knn(df: DataFrame, columns: list[str], k: int = 3, parts: int = 64) -> DataFrame:
    """(feature, mi), in nats and not below zero; df has the columns and the class `y`.

    Null and NaN values and classes are left out, and so are classes with one value. Where r is zero, equal values count as near.
    Values nearer than r are those strictly between x - r and x + r in doubles.
    """
    rows = store(long(df, columns, ("y",))).where("x is not null and not isnan(x) and y is not null")
    cuts = quantiles(rows, ["feature"], "x", [i / parts for i in range(1, parts)], "cuts")
    rows = store(rows.join(cuts, "feature").withColumn("_part", cut_by(F.col("cuts"), F.col("x"))))
    rows = store(radii(rows, k))
    point = F.struct(F.col("x").alias("v"), F.lit(0).alias("side"), F.lit(0).alias("sign"))
    tied = F.col("r") == 0
    upper = F.struct((F.col("x") + F.col("r")).alias("v"), F.when(tied, 1).otherwise(-1).alias("side"), F.lit(1).alias("sign"))
    lower = F.struct((F.col("x") - F.col("r")).alias("v"), F.when(tied, -1).otherwise(1).alias("side"), F.lit(-1).alias("sign"))
    asked = rows.select("feature", "y", "_rn", "_k", "_size", "cuts", F.explode(F.array(point, upper, lower)).alias("a"))
    asked = store(asked.withColumn("_part", cut_by(F.col("cuts"), F.col("a.v"))).drop("cuts"))
    points = rows.groupBy("feature", "_part").agg(F.count("*").alias("_n"))
    # a part may hold questions alone; its points come from the counts of the parts before
    keys = asked.select("feature", "_part").distinct().join(points, ["feature", "_part"], "left")
    past = Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = keys.select("feature", "_part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("feature", "_part").orderBy("a.v", "a.side").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumn("_upto", F.sum((F.col("a.sign") == 0).cast("long")).over(upto)).join(before, ["feature", "_part"])
    near = asked.groupBy("feature", "y", "_rn", "_k", "_size").agg(F.sum(F.col("a.sign") * (F.col("_upto") + F.col("_before"))).alias("m"))
    psi = lambda c: digamma(F.col(c).cast("double"))
    mean = near.groupBy("feature").agg(F.count("*").cast("double").alias("n"), F.avg(psi("_k") - psi("_size") - psi("m")).alias("s"))
    return mean.select("feature", F.greatest(digamma(F.col("n")) + F.col("s"), F.lit(0.0)).alias("mi"))
