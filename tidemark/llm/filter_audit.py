"""How filters interact: what each filter removes in every order, from one SQL CUBE over failure flags and part.

Documents are first counted by part and combination of flags, with partial counts in the map tasks, so the
cube runs over at most 2 ** filters rows a part. A row of its grouping set (flags of a subset, part) with all
these flags false counts the documents that survive the subset, whatever the order of its filters. Each
step of each order joins two subsets: the filters before it, and those with its own filter.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

WORD_GAP = r"[\x20\x09-\x0D]+"


def standard_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E): true where a document fails: under 200 words; under half of the words distinct;
    over 3 % capitals; a character of #$%&*|; the text of a smaller id.

    Null texts are empty and null parts ''. A row without an id is no smaller id to others and never fails E; rows that share
    an id don't fail E by each other. A text many documents share is one row of the joined side, and its many
    documents are on the side whose partitions adaptive execution can split.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("_text"),
        F.size(words).alias("_n"), F.size(F.array_distinct(words)).alias("_u"), F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("_caps"), F.char_length(text).cast("long").alias("_chars"), text.rlike(r"[#$%&*|]").alias("D"),
    )
    rows = common.store(rows.select("doc_id", "part", "_text", (F.col("_n") < 200).alias("A"), (100 * F.col("_u") < 50 * F.col("_n")).alias("B"), (100 * F.col("_caps") > 3 * F.col("_chars")).alias("C"), "D"))
    first = rows.groupBy("_text").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    rows = rows.join(first, "_text", "left")
    return rows.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).alias("E"))


def survivors(counts: DataFrame, flags: list[str], sums: list[str]) -> DataFrame:
    """(part, subset, sums...): for each part and each subset of flags, as bits from the first flag up, the sums over
    the rows that fail none of its flags; zeros included. counts: (part, flags..., sums...)."""
    spark = counts.sparkSession
    cube = counts.cube("part", *flags).agg(F.grouping("part").alias("_all"), *[F.grouping(f).alias(f"_no_{f}") for f in flags], *[F.sum(c).alias(c) for c in sums])
    clean = reduce(lambda a, b: a & b, [(F.col(f"_no_{f}") == 1) | ~F.col(f) for f in flags])
    bits = reduce(lambda a, b: a + b, [(1 - F.col(f"_no_{f}").cast("int")) * (1 << i) for i, f in enumerate(flags)])
    found = cube.where((F.col("_all") == 0) & clean).select("part", bits.alias("subset"), *sums)
    every = counts.select("part").distinct().crossJoin(F.broadcast(spark.range(1 << len(flags)).select(F.col("id").cast("int").alias("subset"))))  # 2 ** flags rows
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])


def audit(counts: DataFrame, flags: list[str]) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each
    part, each order of the flags and each step. counts: (part, flags..., n, good, toxic), one row a combination."""
    spark, k = counts.sparkSession, len(flags)
    bit = {f: 1 << i for i, f in enumerate(flags)}
    steps = [("".join(o), i + 1, o[i], sum(bit[f] for f in o[:i])) for o in permutations(flags) for i in range(k)]
    steps = F.broadcast(spark.createDataFrame([(o, i, f, before, before | bit[f], bit[f], 2**k - 1 - bit[f]) for o, i, f, before in steps], "filter_order string, step int, filter string, before int, after int, alone int, rest int"))
    left = common.store(survivors(counts, flags, ["n", "good", "toxic"]))

    def at(name: str, *cols: str) -> DataFrame:
        return left.select(F.col("part").alias(f"{name}_part"), F.col("subset").alias(f"{name}_set"), *[F.col(c).alias(f"{name}_{c}") for c in cols])

    def beside(df: DataFrame, name: str, subset: Column, *cols: str) -> DataFrame:
        other = at(name, *cols)
        return df.join(other, (other[f"{name}_part"] == df["part"]) & (other[f"{name}_set"] == subset))

    out = left.select("part", F.col("subset").alias("before"), F.col("n").alias("b_n"), F.col("good").alias("b_good"), F.col("toxic").alias("b_toxic")).join(steps, "before")
    out = beside(out, "a", F.col("after"), "n", "good", "toxic")
    out = beside(out, "s", F.col("alone"), "n")  # survivors of the filter by itself
    out = beside(out, "r", F.col("rest"), "n")  # and of all the others
    out = beside(out, "z", F.lit(0), "n")  # all rows
    out = beside(out, "e", F.lit(2**k - 1), "n")  # survivors of every filter
    out = out.withColumn("removed", F.col("b_n") - F.col("a_n"))
    # a subset before the filter comes up in |subset|! * (k - 1 - |subset|)! orders; the sum over orders is that over the pairs
    times = F.element_at(F.array(*[F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k)]), F.bit_count("before") + 1)
    pairs = out.groupBy("part", "filter", "before").agg(F.first("removed").alias("removed"))
    shapley = pairs.groupBy("part", "filter").agg(F.sum(F.col("removed") * times).cast("long").alias("shapley"))
    out = out.join(shapley, ["part", "filter"])
    return out.select(
        "part", "filter_order", "step", "filter", F.col("a_n").alias("kept"), "removed", (F.col("z_n") - F.col("s_n") - F.col("removed")).alias("redundant"), (F.col("r_n") - F.col("e_n")).alias("unique_fails"),
        (F.col("b_good") - F.col("a_good")).alias("good_lost"), (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"), "shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the five standard filters over whole documents, zeros included.

    A document is good or toxic if any label row of its id says so; null labels and ids say nothing. Repeated rows count each.
    Other columns are not read. An empty table gives an empty result. See `standard_flags` for nulls and empty texts.
    """
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flags = ["A", "B", "C", "D", "E"]
    rows = standard_flags(docs, id_col, text_col, part_col).join(said, "doc_id", "left")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = rows.groupBy("part", *flags).agg(F.count("*").alias("n"), n("good").alias("good"), n("toxic").alias("toxic"))
    return audit(common.store(counts), flags)
