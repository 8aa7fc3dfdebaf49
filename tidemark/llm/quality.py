"""Quality by logistic regression over hashed word n-grams, learned with FTRL-proximal updates.

Two streams of word n-grams are hashed into 2**bits weights: the lower-cased words (1- and 2-grams)
and the words' shapes (1- to 3-grams; a shape is the word's run-collapsed classes: capital, small,
digit, each punctuation mark, and whether the word equals the one before). A feature's value is the
square root of its share of the text's words, so long and short texts compare.

Training runs follow-the-regularised-leader on a fixed number of shards of a bounded sample at once
and averages the shards' weights and squared gradients after each epoch, from which the next one goes
on; each shard is bounded by the sample's bound. The
weights are a fixed 2**bits floats, so broadcasting them is bounded at any input size. Scoring is
one sparse dot product per text in the scan's own tasks: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels as K

SHAPE = np.zeros(256, np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:256] = 1, 2, 3, 2
for _c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
    SHAPE[_c] = _c + 100
SHAPE_VALUES = K.seeded(256, 11)


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all rows: sorted (row, slot) pairs and their values."""
    s, e, first = K.words(data, off)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    low = K.word_hashes(K.LOWER[data], s, e)
    kind = SHAPE[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[s] = True
    at = np.append(0, np.cumsum(new))
    shape = K.span(K.prefix(SHAPE_VALUES[kind[new]]), at[s], at[e])
    again = np.zeros(len(s), bool)
    again[1:] = low[1:] == low[:-1]
    again[first[:-1][first[:-1] < len(s)]] = False
    shape = K.mix(shape + again.astype(np.uint64) * np.uint64(K.BASE))
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    rows, slots = [], []
    for tag, h, orders in ((1, low, (1, 2)), (2, shape, (1, 2, 3))):
        p = K.prefix(h)
        for n in orders:
            if len(h) < n:
                continue
            g = K.mix(K.windows(p, n) ^ np.uint64(tag * 16 + n))
            own = row[: len(g)] == row[n - 1 :]
            rows.append(row[: len(g)][own])
            slots.append((g[own] >> np.uint64(64 - bits)).astype(np.int64))
    key, count = np.unique((np.concatenate(rows) << bits) | np.concatenate(slots), return_counts=True)
    row = key >> bits
    return row, key & ((1 << bits) - 1), np.sqrt(count / np.diff(first)[row])


def _training_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in K.chunks(batches):
            row, slot, x = features(data, off, bits)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "y": batch.column("y"), "shard": batch.column("shard"),
                "slot": pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32))),
                "x": pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.float32))),
            })

    return run


def _ftrl(weights: np.ndarray, seen: np.ndarray, alpha: float, beta: float, l1: np.ndarray, l2: float, weight_of: dict[int, float]):
    """One epoch over a shard's rows, from the averaged weights and squared gradients; returns the shard's own.

    The last weight is the intercept: a feature of value 1 without l1.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id"])
        n = seen.copy()
        z = -weights * ((beta + np.sqrt(n)) / alpha + l2) - np.sign(weights) * l1
        one = np.array([len(weights) - 1])

        def value(slot, zi, ni):
            return np.where(np.abs(zi) <= l1[slot], 0.0, -(zi - np.sign(zi) * l1[slot]) / ((beta + np.sqrt(ni)) / alpha + l2))

        for slot, x, y in zip(rows["slot"], rows["x"], rows["y"]):
            slot, x = np.append(slot, one), np.append(x, 1.0)
            zi, ni = z[slot], n[slot]
            w = value(slot, zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * weight_of[int(y)] * x
            grown = ni + g * g
            z[slot] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[slot] = grown
        w = value(slice(None), z, n)
        at = np.flatnonzero((w != 0) | (n != seen))
        return pd.DataFrame({"slot": at.astype(np.int64), "w": w[at], "n": n[at] - seen[at]})

    return run


def train(rows: DataFrame, bits: int = 18, shards: int = 8, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights (the last is the intercept) from rows (doc_id, text, y)."""
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int")
    ready = rows.select("doc_id", "text", "y", shard.alias("shard")).mapInArrow(_training_rows(bits), "doc_id long, y int, shard int, slot array<int>, x array<float>")
    ready = common.store(ready.withColumn("order", F.xxhash64(F.lit("order"), "doc_id")))
    count = {r.y: r.n for r in ready.groupBy("y").agg(F.count("*").alias("n")).collect()}
    used = max(1, ready.select("shard").distinct().count())  # a shard without rows has no say in the averages
    total = sum(count.values())
    weight_of = {y: (total / (len(count) * n)) ** 0.5 for y, n in count.items()}
    size = (1 << bits) + 1
    w, n, sparse = np.zeros(size), np.ones(size), np.full(size, l1)
    sparse[-1] = 0.0
    for _ in range(epochs):
        parts = ready.groupBy("shard").applyInPandas(_ftrl(w, n, alpha, beta, sparse, l2, weight_of), "slot long, w double, n double")
        t = parts.groupBy("slot").agg((F.sum("w") / used).alias("w"), (F.sum("n") / used).alias("n")).toArrow()
        at = t.column("slot").to_numpy()
        w = np.zeros(size)
        w[at] = t.column("w").to_numpy()
        n[at] += t.column("n").to_numpy()
    return w


def _score(bits: int, shared):
    def run(batches):
        w = shared.value
        for batch, data, off in K.chunks(batches):
            row, slot, x = features(data, off, bits)
            z = w[-1] + np.bincount(row, w[slot] * x, batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))})

    return run


def quality(
    docs: DataFrame, labels: DataFrame, held_out_of: int = 4, held_out_is: int = 2, max_rows_per_class: int = 8_000, threshold: float = 0.7,
    bits: int = 18, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Learns only from labelled rows that are not held out, about max_rows_per_class of each class (a
    documented bound; picked by a hash of the id). Scores whole texts of all rows. Null and empty
    texts have no features and score by the intercept. Null labels are not learned from; without
    labels of both classes every score is 0.5. Repeated rows score alike. Texts of any length are scored
    whole. Other columns are not read.
    """
    docs = common.texts(docs, id_col, text_col)
    held = common.fold("doc_id", held_out_of) == held_out_is
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held)
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (count.get(0) and count.get(1)):
        return docs.select("doc_id", held.alias("held_out"), F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    picked = [common.bounded_sample(known.where(F.col("y") == y), "doc_id", max_rows_per_class, count[y]) for y in (0, 1)]
    w = train(docs.join(picked[0].union(picked[1]).dropDuplicates(["doc_id"]), "doc_id"), bits)
    shared = docs.sparkSession.sparkContext.broadcast(w)
    scored = docs.mapInArrow(_score(bits, shared), "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
