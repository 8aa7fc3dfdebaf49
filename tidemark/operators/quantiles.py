"""Exact quantiles and ranks of many keys at once, without holding a key's values in one place.

An order statistic is found by its rank: a histogram between a key's least and largest value names the bin that the
rank falls into, a second one divides that bin by its own ends, and the distinct values left in the last bin are counted in
order. Each pass sums in the map tasks over a stored table of keys and values. Nulls and NaN don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import store

BINS = 1024


def values(df: DataFrame, key: list[str], x: str) -> DataFrame:
    c = F.col(x).cast("double")
    return df.select(*key, (c + F.lit(0.0)).alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))  # + 0.0: one zero


def _bin(bins: int) -> Column:
    """Grows with the value; the ends of a range that isn't a point fall into different bins."""
    wide = F.col("_hi") - F.col("_lo")
    at = F.when(wide < float("inf"), F.try_divide(F.col("_x") - F.col("_lo"), wide)).otherwise((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2))
    return F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(at * bins), F.lit(bins - 1))).otherwise(F.lit(0))


def order_statistics(rows: DataFrame, key: list[str], wanted: DataFrame, bins: int = BINS, levels: int = 2) -> DataFrame:
    """wanted (a key of one column or more, _rank from 0, ...) with `_value`, the value at that rank among the rows (key, _x) of its key."""
    ends = rows.groupBy(*key).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    now = store(wanted.join(ends, key)).withColumn("_below", F.lit(0).cast("long"))
    span = [*key, "_lo", "_hi"]

    def inside() -> DataFrame:
        ranges = now.select(*span).distinct()
        return rows.join(ranges, key).where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))

    def taken(parts: DataFrame, order: str) -> DataFrame:
        upto = F.sum("_n").over(Window.partitionBy(*span).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        parts = parts.withColumn("_from", upto - F.col("_n"))
        return now.join(parts, span).where((F.col("_rank") >= F.col("_below") + F.col("_from")) & (F.col("_rank") < F.col("_below") + F.col("_from") + F.col("_n")))

    for _ in range(levels):
        hist = inside().groupBy(*span, _bin(bins).alias("_bin")).agg(F.count("*").alias("_n"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        now = store(taken(hist, "_bin").select(*wanted.columns, F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_below") + F.col("_from")).alias("_below")))
    last = inside().groupBy(*span, "_x").agg(F.count("*").alias("_n"))
    return taken(last, "_x").select(*wanted.columns, F.col("_x").alias("_value"))


def quantiles(df: DataFrame, key: list[str], x: str, probs: list[float], out: str = "quantiles", bins: int = BINS) -> DataFrame:
    """(key, out): the exact quantiles of x at `probs`, between neighbours in proportion. Keys without values are left out."""
    rows = store(values(df, key, x))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    n = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 0").withColumn("_at", at)
    place = F.col("_at.p") * (F.col("_n") - 1)
    n = n.select(*key, F.col("_at.q").alias("_q"), place.alias("_place"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_rank"))
    got = order_statistics(rows, key, n, bins).groupBy(*key, "_q", "_place").agg(F.min_by("_value", "_rank").alias("_a"), F.max_by("_value", "_rank").alias("_b"))
    low = F.floor("_place")
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((low + 1 - F.col("_place")) * F.col("_a") + (F.col("_place") - low) * F.col("_b"))
    one = F.transform(F.array_sort(F.collect_list(F.struct("_q", value.alias("_v")))), lambda s: s["_v"])  # as many as `probs`
    return store(got.groupBy(*key).agg(one.alias(out)))


def cut_by(cuts: Column, x: Column) -> Column:
    """How many of the sorted cuts are below x."""
    return F.size(F.filter(cuts, lambda c: c < x))
