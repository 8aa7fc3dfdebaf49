"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model are trained on labelled texts of which exact copies were dropped. Each
interpolates four levels with absolute discounts n1 / (n1 + 2 n2), one per class and level:

1. the class's bigrams, by their occurrences;
2. the shared bigrams: in how many of the two classes a bigram occurs;
3. the class's words, by the number of distinct words before them (continuation counts);
4. the shared words: in how many of the two classes a word occurs; the rest is spread evenly.

Levels 2 and 4 are the same for both classes. A rare word or bigram takes most of its probability
from there, so one sighting tells little, while a frequent expression keeps its class's probability.
Since a shared count is of classes and not of occurrences, what one class says often gains nothing
in the other. Nothing is dropped for being rare; with `least` above 1 rarer bigrams would go to the backoff, whose
mass grows by theirs, so that probabilities still sum to one. The models hold counts, and of bigrams seen once only their keys.

The log-likelihoods of both models are compared by words (levels 3 and 4) and by bigrams (all four),
over the whole text and over segments of `segment` words, each divided by its length. The whole
text's ratios and those of the strongest segments are the features of a logistic curve, fitted on
labelled texts that the models have not seen, which turns them into a probability.

Counts are Spark aggregations over a bounded sample of labelled rows, so the models that are
broadcast are bounded by that sample's text.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels as K

# Letters, digits, the apostrophe and all bytes of non-ASCII characters make words here.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
START = np.uint64(1)
NTH = (0, 1, 3)  # which of the strongest segments are features
N_FEATURES = 2 * (1 + len(NTH))
PARTS = 8


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and the n + 1 word offsets of the rows."""
    low = K.LOWER[data]
    s, e, first = K.words(low, off, LETTERS)
    return K.word_hashes(low, s, e), first


def before(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word, START for a row's first."""
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    at = first[:-1][first[:-1] < first[1:]]
    prev[at] = START
    return prev


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, off in K.chunks(batches):
        h, first = tokens(data, off)
        if not len(h):
            continue
        toxic = np.repeat(batch.column("y").to_numpy(zero_copy_only=False), np.diff(first))
        a = before(h, first)
        _, at, inv = np.unique(pair_key(a, h), return_index=True, return_inverse=True)
        tox = np.bincount(inv, toxic, len(at)).astype(np.int64)
        n = np.bincount(inv, minlength=len(at)).astype(np.int64)
        yield pa.record_batch({"a": K.signed(a[at]), "b": K.signed(h[at]), "tox": pa.array(tox), "ord": pa.array(n - tox)})


@dataclass
class Model:
    """Sorted keys and, per class (0 ordinary, 1 toxic), probabilities."""

    word: np.ndarray
    word_p: np.ndarray  # (n, 2) levels 3 and 4
    unseen_p: np.ndarray  # (2,)
    pair: np.ndarray
    pair_n: np.ndarray  # (n, 2) occurrences
    once: tuple[np.ndarray, np.ndarray]  # sorted keys of the bigrams seen once in all, in either class
    off: np.ndarray  # (3,) discounts of the classes' and the shared bigrams
    ctx: np.ndarray
    ctx_n: np.ndarray  # (n, 2) occurrences of a context, at least 1
    ctx_shared: np.ndarray  # (n,) the same, of classes
    ctx_left: np.ndarray  # (n, 2) mass that a context leaves to the shared bigrams
    ctx_back: np.ndarray  # (n,) what those leave of it to the words

    def ratios(self, h: np.ndarray, prev: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word, by words and by bigrams: (n, 2)."""
        p = _look(self.word, self.word_p, h, self.unseen_p)
        at, n = K.find(self.ctx, prev), self.pair_counts(pair_key(prev, h))
        known = at >= 0
        top, back = np.zeros((len(h), 2)), np.ones((len(h), 2))
        at, n = at[known], n[known]
        shared = np.maximum((n > 0).sum(axis=1) - self.off[2], 0) / self.ctx_shared[at] if len(at) else np.zeros(0)
        top[known] = np.maximum(n - self.off[:2], 0) / self.ctx_n[at] + self.ctx_left[at] * shared[:, None]
        back[known] = self.ctx_left[at] * self.ctx_back[at][:, None]
        both = np.log(top + back * p)
        p = np.log(p)
        return np.stack([p[:, 1] - p[:, 0], both[:, 1] - both[:, 0]], 1)


    def pair_counts(self, key: np.ndarray) -> np.ndarray:
        """Occurrences of bigrams, (n, 2)."""
        at = K.find(self.pair, key)
        n = self.pair_n[at].astype(np.int64) if len(self.pair) else np.zeros((len(key), 2), np.int64)
        n[at < 0] = 0
        for y, keys in enumerate(self.once):
            n[K.find(keys, key) >= 0, y] = 1
        return n


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix(a * np.uint64(3) + K.mix(b))


def _look(keys: np.ndarray, values: np.ndarray, x: np.ndarray, other: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(other, (len(x), 2))
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where((keys[at] == x)[:, None], values[at], other)


def _arrays(df: DataFrame, *cols: str) -> list[np.ndarray]:
    t = df.select(*cols).toArrow()
    return [t.column(c).to_numpy() for c in cols]


def _discounts(counts: DataFrame, *columns: str) -> list[float]:
    """The absolute discount of each column of counts, n1 / (n1 + 2 n2); 0.5 where no count is 1."""
    ones = counts.agg(*[F.count_if(F.col(c) == m) for c in columns for m in (1, 2)]).first()
    return [float(n1 / (n1 + 2 * n2)) if n1 else 0.5 for n1, n2 in zip(ones[::2], ones[1::2])]


def _used(c: str, d: float, kept=None):
    """Sum of counts less their discounts, of the rows `kept`."""
    x = F.greatest(F.col(c) - F.lit(d), F.lit(0.0))
    return F.sum(x if kept is None else F.when(kept, x).otherwise(F.lit(0.0)))


def fit(rows: DataFrame, least: int = 1) -> Model:
    """The two models from (text, y); y is 1 for toxic texts."""
    n_classes = ((F.col("ord") > 0).cast("int") + (F.col("tox") > 0).cast("int")).alias("both")
    pairs = rows.mapInArrow(_bigrams, "a long, b long, tox long, ord long").groupBy("a", "b").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord"))
    pairs = common.store(pairs.select("*", n_classes))
    words = pairs.groupBy("b").agg(*[F.count_if(F.col(c) > 0).alias(c) for c in ("ord", "tox")])
    words = common.cut(words.select("*", n_classes))
    d0, d1, ds = _discounts(words, "ord", "tox", "both")
    n0, n1, ns, u0, u1, us, many = words.agg(
        F.sum("ord"), F.sum("tox"), F.sum("both"), _used("ord", d0), _used("tox", d1), _used("both", ds), F.count("*")
    ).first()
    n, used = np.array([n0 or 0, n1 or 0], float), np.array([u0 or 0, u1 or 0])
    left = np.where(n > 0, 1 - used / np.maximum(n, 1), 1.0)  # mass that a class leaves to the shared words
    even = (1 - (us or 0.0) / max(ns or 0, 1)) / ((many or 0) + 1)  # of each word, and of all unseen ones together
    b, w0, w1, t = _arrays(words, "b", "ord", "tox", "both")
    c = np.stack([w0, w1], 1).astype(float)
    shared = np.maximum(t - ds, 0) / max(ns or 0, 1) + even
    p = np.maximum(c - np.array([d0, d1]), 0) / np.maximum(n, 1) + left * shared[:, None]
    order = np.argsort(b.view(np.uint64))

    e0, e1, es = _discounts(pairs, "ord", "tox", "both")
    kept = F.col("ord") + F.col("tox") >= least
    ctx = pairs.groupBy("a").agg(
        F.sum("ord").alias("c0"), F.sum("tox").alias("c1"), F.sum("both").alias("cs"),
        _used("ord", e0, kept).alias("u0"), _used("tox", e1, kept).alias("u1"), _used("both", es, kept).alias("us"), F.max(kept.cast("int")).alias("any"),
    ).where("any = 1")
    x, c0, c1, cs, u0, u1, us = _arrays(ctx, "a", "c0", "c1", "cs", "u0", "u1", "us")
    o3 = np.argsort(x.view(np.uint64))
    x, count = x.view(np.uint64)[o3], np.maximum(np.stack([c0, c1], 1)[o3], 1).astype(float)
    lam = 1 - np.stack([u0, u1], 1)[o3] / count  # a class without the context leaves all
    lam_shared = 1 - us[o3] / cs[o3]
    key, q, once = [], [], ([], [])
    for part in range(PARTS):  # some at a time: the driver holds no more than these beside the finished arrays
        mine = pairs.where(kept & (F.pmod(F.xxhash64("a"), F.lit(PARTS)) == part)).select("a", "b", F.col("ord").cast("int").alias("ord"), F.col("tox").cast("int").alias("tox"))
        a2, b2, q0, q1 = _arrays(mine, "a", "b", "ord", "tox")
        k, many = pair_key(a2.view(np.uint64), b2.view(np.uint64)), q0 + q1 > 1
        key.append(k[many])
        q.append(np.stack([q0, q1], 1)[many].astype(np.uint32))
        for y, c in enumerate((q0, q1)):
            once[y].append(k[~many & (c == 1)])
    key, q, once = np.concatenate(key), np.concatenate(q), tuple(np.sort(np.concatenate(o)) for o in once)
    o2 = np.argsort(key)
    gc.collect()
    pa.default_memory_pool().release_unused()
    return Model(b.view(np.uint64)[order], p[order], left * even, key[o2], q[o2], once, np.array([e0, e1, es]), x, count.astype(np.uint32), cs[o3].astype(np.uint32), lam, lam_shared)


def features(model: Model, data: np.ndarray, off: np.ndarray, segment: int) -> np.ndarray:
    """Per row, by words and by bigrams: the whole text's ratio and those of the NTH strongest segments, each by length."""
    h, first = tokens(data, off)
    n_rows = len(off) - 1
    out = np.zeros((n_rows, N_FEATURES))
    if not len(h):
        return out
    n = np.diff(first)
    k = (n + segment - 1) // segment
    row = np.repeat(np.arange(n_rows), k)
    begin = np.cumsum(k) - k
    a = first[row] + (np.arange(len(row)) - np.repeat(begin, k)) * segment
    b = np.minimum(a + segment, first[row + 1])
    for which, r in enumerate(model.ratios(h, before(h, first)).T):
        col = which * (1 + len(NTH))
        total = np.append(0, np.cumsum(r))
        out[:, col] = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        score = (total[b] - total[a]) / segment
        score = score[np.lexsort((-score, row))]
        for j, nth in enumerate(NTH, col + 1):
            ok = k > nth
            out[ok, j] = score[begin[ok] + nth]
    return out


def _scorer(segment: int, curve: np.ndarray | None, broadcast):
    def run(batches):
        m = broadcast.value
        for batch, data, off in K.chunks(batches):
            x = features(m, data, off, segment)
            if curve is not None:
                z = np.clip(x @ curve[1:] + curve[0], -30, 30)
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_sha256": batch.column("text_sha256"), "score": pa.array(1 / (1 + np.exp(-z)))})
            else:
                yield pa.record_batch({"y": batch.column("y").cast(pa.int64()), **{f"x{j}": pa.array(x[:, j]) for j in range(N_FEATURES)}})

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Intercept and weights by damped Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    reg = np.full(a.shape[1], ridge)
    reg[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(reg + 1e-9), a.T @ (y - p) - reg * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(
    docs: DataFrame, labels: DataFrame, held_out_of: int = 5, held_out_is: int = 0, max_toxic: int = 4_000, max_ordinary: int = 8_000,
    segment: int = 4, threshold: float = 0.5, least: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold), text_sha256.

    Learns only from labelled rows that are not held out: about max_toxic and max_ordinary of them
    (a documented bound; picked by a hash of the id), three quarters for the models and one quarter
    for the logistic curve. Scores whole texts of all rows. Null and empty texts score as a text
    without evidence. Null labels are not learned from; without labels of both classes every score
    is 0.0. Repeated rows score alike. Other columns of either table are not read.
    """
    docs = common.texts(docs, id_col, text_col)
    spark, digest = docs.sparkSession, F.sha2(F.coalesce("text", F.lit("")), 256)
    held = common.fold("doc_id", held_out_of) == held_out_is
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held)
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (count.get(0) and count.get(1)):
        return docs.select("doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), digest.alias("text_sha256"))
    picked = [common.bounded_sample(known.where(F.col("y") == y), "doc_id", b, count[y]) for y, b in ((0, max_ordinary), (1, max_toxic))]
    sample = docs.join(picked[0].union(picked[1]).dropDuplicates(["doc_id"]), "doc_id")
    sample = common.store(sample.withColumn("same", F.xxhash64("text")).dropDuplicates(["same", "y"]).drop("same"))
    part = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(4))
    shared = spark.sparkContext.broadcast(fit(sample.where(part != 0), least))  # once; the driver keeps no copy
    common._release(spark)
    t = sample.where(part == 0).mapInArrow(_scorer(segment, None, shared), "y long, " + ", ".join(f"x{j} double" for j in range(N_FEATURES))).toArrow()
    x = np.column_stack([t.column(f"x{j}").to_numpy() for j in range(N_FEATURES)])
    y = t.column("y").to_numpy().astype(float)
    if len(set(y)) == 2:
        curve = logistic(x, y)
        odds = y.mean() / (1 - y.mean())  # of the sample; the labels' own odds take their place
        curve[0] += np.log(count[1] / count[0]) - np.log(odds)
    else:
        curve = np.array([-1.0, *[1.0] * N_FEATURES])  # too few labels for a fit
    scored = docs.withColumn("text_sha256", digest).mapInArrow(_scorer(segment, curve, shared), "doc_id long, text_sha256 string, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_sha256")
