"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic; the cells' token weights are raked
until their marginals meet the targets, and each document gets the probability
min(1, level * weight of its cell / tokens of its cell), the level being set so that the expected
tokens are the wanted share of all. A document is kept if a uniform hash of its id is below it.

Topics are the nearest of `topics` centroids of the documents' words. A document is a vector of `WIDE`
signed sums of its words' hashes, each word weighing the logarithm of its count, less the mean of its
language (so that topics tell contents apart, not languages), scaled to length one. The centroids are
learned over all documents by spherical k-means: each round is one pass over the stored vectors that
sums them by topic in the map tasks. They start from documents of a fixed hash order, each the farthest
from those before it, of at most `SEEDS`.

Cells stay a DataFrame throughout: each raking step is a sum by one dimension (partial sums in the map
tasks) and a join with those sums, which Spark broadcasts only below its own size limit. The level
is solved exactly by a few sums over the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels as K

DIMS = ("source", "lang", "topic")
CARRIED = ("doc_id", "source", "lang", "text_sha256")
WIDE, SEEDS = 64, 512


def _counted(batches):
    for batch, data, off in K.chunks(batches):
        low = K.LOWER[data]
        s, e, first = K.words(low, off)
        h = K.word_hashes(low, s, e)
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        key = np.stack([row.astype(np.uint64), h], 1)
        vec = np.zeros((batch.num_rows, WIDE))
        if len(key):
            order = np.lexsort((h, row))
            new = np.append(True, (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1]))
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(order)))
            w, r = h[order][at], row[order][at]
            slot = ((w >> np.uint64(8)) % np.uint64(WIDE)).astype(np.int64)
            np.add.at(vec, (r, slot), np.where(w & np.uint64(1), 1.0, -1.0) * np.log1p(count))
            vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
        yield pa.record_batch({c: batch.column(c) for c in CARRIED} | {"n_tokens": pa.array(np.diff(first).astype(np.int64)), "vec": pa.array([v.astype(np.float32).tobytes() for v in vec], pa.binary())})


def _vectors(batch: pa.RecordBatch, mean: dict[str, np.ndarray]) -> np.ndarray:
    x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float32).reshape(-1, WIDE).astype(float)
    x = x - np.stack([mean.get(v, np.zeros(WIDE)) for v in batch.column("lang").to_pylist()])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _summed(shared, by_topic: bool):
    """Sums of the vectors by language, or by nearest centroid: one row for each key and batch."""

    def run(batches):
        mean, centres = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b, mean)
            keys = np.array([str(k) for k in (x @ centres.T).argmax(axis=1)] if by_topic else b.column("lang").to_pylist())
            for k in np.unique(keys):
                mine = keys == k
                yield pa.record_batch({"key": pa.array([k]), "n": pa.array([int(mine.sum())]), "total": pa.array([x[mine].sum(axis=0).tolist()], pa.list_(pa.float64()))})

    return run


def _totals(rows: DataFrame, shared, by_topic: bool) -> dict[str, np.ndarray]:
    """Per key the mean of the vectors, summed in double precision in a fixed order of keys."""
    parts = rows.mapInArrow(_summed(shared, by_topic), "key string, n long, total array<double>")
    sums = parts.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(WIDE)])
    return {r.key: np.array([r[f"t{i}"] for i in range(WIDE)]) / r.n for r in sums.collect()}  # languages or topics: few keys


def _assigned(shared):
    def run(batches):
        mean, centres = shared.value
        for b in batches:
            topic = (np.round(_vectors(b, mean) @ centres.T, 9)).argmax(axis=1) if b.num_rows else np.zeros(0, int)
            topic = np.where(b.column("n_tokens").to_numpy() > 0, topic, -1)
            yield pa.record_batch({c: b.column(c) for c in CARRIED} | {"topic": pa.array(topic.astype(np.int32)), "n_tokens": b.column("n_tokens")})

    return run


def with_topics(rows: DataFrame, topics: int, rounds: int = 3) -> DataFrame:
    """(doc_id, source, lang, text_sha256, topic, n_tokens) of rows (doc_id, text, source, lang); -1 for texts without words."""
    sc = rows.sparkSession.sparkContext
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    rows = common.store(rows.mapInArrow(_counted, "doc_id long, source string, lang string, text_sha256 string, n_tokens long, vec binary"))
    full = rows.where("n_tokens > 0")
    none = np.zeros((1, WIDE))
    mean = _totals(full, sc.broadcast(({}, none)), False)
    seeds = full.orderBy(F.xxhash64(F.lit("seed"), "vec"), "doc_id").select("vec", "lang").limit(SEEDS).toArrow()
    x = _vectors(seeds.combine_chunks().to_batches()[0], mean) if seeds.num_rows else none
    centres = [x[0]]
    while len(centres) < topics:
        centres.append(x[np.round(np.max(x @ np.stack(centres).T, axis=1), 9).argmin()])
    centres = np.stack(centres)
    for _ in range(rounds):
        new = _totals(full, sc.broadcast((mean, centres)), True)
        centres = np.stack([new[str(i)] / max(np.linalg.norm(new[str(i)]), 1e-12) if str(i) in new else c for i, c in enumerate(centres)])
    return rows.mapInArrow(_assigned(sc.broadcast((mean, centres))), "doc_id long, source string, lang string, text_sha256 string, topic int, n_tokens long")


def targets(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """For each dimension (value, share): its token shares raised to a power, and scaled to one."""
    out = {}
    for dim in DIMS:
        t = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(powers[dim])).alias("p"))
        total = t.agg(F.sum("p").alias("all"))
        out[dim] = t.crossJoin(F.broadcast(total)).select("value", F.try_divide("p", "all").alias("share"))
    return out


def rake(cells: DataFrame, wanted: dict[str, DataFrame], sweeps: int = 40, tolerance: float = 1e-4) -> tuple[DataFrame, float]:
    """Cells with `weight`, their share of the mixture, and the largest miss of a marginal that is left, as a share of the whole.

    A sweep rakes each dimension in turn; it ends when no marginal missed its target by `tolerance` at its turn. Targets
    that no weights can meet end it too: when a sweep comes no nearer than the one before, or after `sweeps`. Each sweep
    is stored as a table, whose file sizes keep the next sweep's joins planned by what the cells really are.
    """
    total, many = cells.agg(F.sum("tokens"), F.count("*")).first()
    cells = cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    if many == 0:
        return cells, 0.0
    goal = {d: common.store(wanted[d].withColumnRenamed("value", d)) for d in DIMS}
    names, last = cells.columns, float("inf")
    for _ in range(sweeps):
        for d in DIMS:
            have = cells.groupBy(d).agg(F.sum("weight").alias("have")).join(goal[d], d, "left")
            share = F.coalesce("share", F.lit(0.0))
            have = have.select(d, F.try_divide(share, F.col("have")).alias("factor"), F.abs(share - F.col("have")).alias(f"gap_{d}"))
            cells = cells.join(have, d).withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
        cells = common.store(cells)
        gap = cells.agg(F.max(F.greatest(*[f"gap_{d}" for d in DIMS]))).first()[0]
        cells = cells.select(*names)
        if gap < tolerance or gap > 0.99 * last:
            break
        last = gap
    return cells, left(cells, goal)


def left(cells: DataFrame, goal: dict[str, DataFrame]) -> float:
    """The largest difference between a wanted share and the weights of its value, over all dimensions; values
    that no cell has count too."""
    worst = 0.0
    for d in DIMS:
        have = cells.groupBy(d).agg(F.sum("weight").alias("have"))
        gap = have.join(goal[d], d, "full").agg(F.max(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("have", F.lit(0.0))))).first()[0]
        worst = max(worst, gap or 0.0)
    return worst


def level(cells: DataFrame, budget: float) -> float:
    """The level at which sum(min(tokens, level * weight)) is the budget.

    That sum grows with the level along straight pieces that only get flatter, so Newton's steps from zero never pass
    the answer and reach it once the set of full cells stays the same. Each step is one sum over the cells.
    """
    at, seen = 0.0, None
    while True:
        full = F.lit(at) * F.col("weight") >= F.col("tokens")
        r = cells.where("tokens > 0 and weight > 0").agg(F.sum(F.when(full, F.col("tokens"))).alias("t"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.count_if(full).alias("n")).first()
        if not r.w:
            return float("inf")
        at = max(at, (budget - (r.t or 0)) / r.w)
        if r.n == seen:
            return at
        seen = r.n


def mix(
    docs: DataFrame, keep_share: float = 0.5, powers: dict[str, float] | None = None, wanted: dict[str, DataFrame] | None = None, topics: int = 8, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """Per document: doc_id, source, lang, topic, n_tokens, probability, weight (1 / probability), kept, target_gap, text_sha256.

    target_gap is the same in all rows: the share of the whole by which the worst marginal still misses its target
    (targets that contradict each other or the cells at hand leave one). text_sha256 tells the text, where an id has several.

    Default targets are the token shares to the powers 0.7 (source), 0.8 (lang) and 0.5 (topic); a
    dimension's `wanted` table (value, share) replaces them. Null sources and languages are the value
    ''. Texts without words (null, empty) have topic -1 and no tokens and are not sampled. A dimension
    value without a wanted share gets none. Repeated rows share an id and its decision. A null id
    counts as one id. Of equally near topics the first is taken. Texts of any length are read whole.
    Other columns are not read. An empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text(text_col).alias("text"), text(source_col).alias("source"), text(lang_col).alias("lang"))
    rows = common.store(with_topics(rows, topics))
    cells = common.cut(rows.where("n_tokens > 0").groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")))
    goal = targets(cells, {"source": 0.7, "lang": 0.8, "topic": 0.5} | (powers or {})) | (wanted or {})
    cells, gap = rake(cells, goal)
    budget = keep_share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    at = level(cells, budget)
    chance = cells.select(*DIMS, F.least(F.lit(1.0), F.lit(at) * F.col("weight") / F.col("tokens")).alias("probability"))
    out = rows.join(chance, list(DIMS), "left")
    p = F.coalesce("probability", F.lit(0.0))
    u = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0))), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return out.select("doc_id", *DIMS, "n_tokens", p.alias("probability"), F.try_divide(F.lit(1.0), p).alias("weight"), (u < p).alias("kept"), F.lit(gap).alias("target_gap"), "text_sha256")
