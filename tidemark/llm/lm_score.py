"""Language-model scoring by a weighted backoff automaton.

Unless `arcs` is given, the automaton is complete and `lm_pieces` builds and walks it. What follows is the bounded one that
`arcs` asks for, whose rare trigrams fall back to their bigrams.

The corpus is counted whole: every word and every bigram of the training texts is part of the model.
States are the root, one per word (the bigram histories) and one per frequent bigram (the trigram
histories). At the root a word has its add-0.1 unigram probability p1. A word state v holds
    p2(w | v) = (c(v, w) + mu * p1(w)) / (c(v) + mu),
that is an arc for each bigram seen, and for the others a failure arc to the root that weighs
mu / (c(v) + mu). A state (u, v) has arcs for its frequent trigrams,
    p3(w | u, v) = (c(u, v, w) + (mu + c(u, v) - kept) * p2(w | v)) / (c(u, v) + mu),
kept being the count of those arcs, and a failure arc to v that weighs the factor of p2. Each state's
probabilities sum to one. One traversal from left to right carries the state and adds log-weights.

A bigram or trigram is frequent where it makes up at least 1 / `arcs` of the training tokens, at every
size; so there are at most `arcs` of each, and they are broadcast with the counts of the commonest
words. That is a shortcut for the bigrams: the traversal finishes what it holds at once and asks for
all others, which meet their counts in one shuffle by bigram (a bigram that isn't frequent makes no hot
key). A bigram seen once counts like any other, and nothing is dropped as the corpus grows.

An arc's weight is split as p1(w) * mu / (c(v) + mu) * (1 + c(v, w) / (mu * p1(w))), so the first factor
needs w's count, the second v's and only the third the bigram's. Words that are not broadcast get their
counts by a join; the text's words, its end put first, are also its histories.

The questions are the bulk of the shuffle: one row for each different bigram of a text. They are put in
`rounds` rounds by bigram, so a round holds one part of them on disk; results don't depend on it.

Words and bigrams are told apart by 64-bit hashes, rows by a 64-bit hash of id and text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common, kernels as K
from tidemark.llm.lm_pieces import END, before as _before, complete, tokens

TRAIN, RARE = 1, 2


def _word_counts(batches):
    for k, c in K.tallies(tokens(data, off)[0] for _, data, off in K.chunks(batches)):
        yield pa.record_batch({"w": K.signed(k), "n": pa.array(c, pa.int64())})


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Automaton:
    """What is broadcast: counts of common words, frequent bigrams and trigrams, each sorted by key."""

    total: int
    distinct: int
    mu: float
    words: np.ndarray
    word_n: np.ndarray
    frequent: np.ndarray  # places in words
    pairs: np.ndarray = field(default_factory=_none)  # place << 32 | place
    pair_n: np.ndarray = field(default_factory=_none)
    triples: np.ndarray = field(default_factory=_none)  # pair << 32 | pair
    pair_p: np.ndarray = field(default_factory=_none)  # log10 p2
    pair_fail: np.ndarray = field(default_factory=_none)
    triple_p: np.ndarray = field(default_factory=_none)

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def places(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's place in words, its bigram's in pairs, and the state of the two tokens before it; -1 for none."""
        w = K.find(self.words, h)
        own = np.where(self.frequent[w], w, -1) if len(self.words) else w
        prev = _before(own, first, own[first[1] - 1] if len(first) > 1 else -1)
        arc = np.full(len(w), -1)
        both = np.flatnonzero((own >= 0) & (prev >= 0))
        arc[both] = K.find(self.pairs, (prev[both] << 32) | own[both])
        return w, arc, _before(arc, first, -1)

    def frequent_pairs(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        w = K.find(self.words, h)
        own = np.where(self.frequent[w], w, -1) if len(self.words) else w
        prev = _before(own, first, own[first[1] - 1] if len(first) > 1 else -1)
        both = (own >= 0) & (prev >= 0)
        return (prev[both] << 32) | own[both]

    def frequent_triples(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        _, arc, state = self.places(h, first)
        both = (arc >= 0) & (state >= 0)
        return (state[both] << 32) | arc[both]

    def weights(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per token: log10 of the model's and the root's weight as far as known here, place of the word, whether its bigram is open."""
        w, arc, state = self.places(h, first)
        n = np.where(w >= 0, self.word_n[w], -1) if len(self.words) else w
        p1 = np.zeros(len(h))
        p1[w >= 0] = np.log10(self.root(n[w >= 0]))
        back = np.zeros(len(h))
        back[w >= 0] = np.log10(self.mu / (n[w >= 0] + self.mu))
        out = p1 + _before(back, first, back[first[1] - 1] if len(first) > 1 else 0)
        got2 = np.flatnonzero(arc >= 0)
        out[got2] = self.pair_p[arc[got2]]
        inner = np.flatnonzero(state >= 0)
        out[inner] += self.pair_fail[state[inner]]
        inner = inner[arc[inner] >= 0]
        arc3 = K.find(self.triples, (state[inner] << 32) | arc[inner])
        out[inner[arc3 >= 0]] = self.triple_p[arc3[arc3 >= 0]]
        return out, p1, w, arc < 0


def _frequent(train: DataFrame, a: Automaton, name: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the bigrams or trigrams seen at least `least` times; at most total / least."""
    shared = train.sparkSession.sparkContext.broadcast(a)

    def run(batches):
        keys = getattr(shared.value, name)
        for k, c in K.tallies(keys(*tokens(data, off)) for _, data, off in K.chunks(batches)):
            yield pa.record_batch({"k": pa.array(k), "n": pa.array(c, pa.int64())})

    t = train.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    k, n = t.column("k").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(k)
    return k[order], n[order]


def fit(train: DataFrame, arcs: int = 1_000_000, hot: int = 262_144, mu: float = 100.0) -> tuple[Automaton, DataFrame]:
    """The broadcast part of the automaton, and the table (w, n) of all words' counts."""
    counts = common.cut(train.mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, -(-total // arcs))
    t = common.commonest(counts, hot).union(counts.where(F.col("n") >= least)).distinct().toArrow()
    w, n = t.column("w").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.argsort(w)
    a = Automaton(total, distinct, mu, w[order], n[order], n[order] >= least)
    k2, n2 = _frequent(train, a, "frequent_pairs", least)
    a.pairs, a.pair_n = k2, n2
    k3, n3 = _frequent(train, a, "frequent_triples", least)
    p2 = (n2 + mu * a.root(a.word_n[k2 & 0xFFFFFFFF])) / (a.word_n[k2 >> 32] + mu)
    kept = np.bincount(k3 >> 32, n3, len(k2))
    a.pair_p = np.log10(p2)
    a.pair_fail = np.log10((mu + n2 - kept) / (n2 + mu))
    state = k3 >> 32
    a.triples = k3
    a.triple_p = np.log10((n3 + (mu + n2 - kept)[state] * p2[k3 & 0xFFFFFFFF]) / (n2[state] + mu))
    return a, counts


def _bigrams(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(_before(h, first, np.uint64(END)) * np.uint64(K.BASE) + h)


def _once(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each (row, key), in order, and how often each occurs."""
    _, at, n = np.unique(K.mix(key ^ K.mix(row.astype(np.uint64))), return_index=True, return_counts=True)
    order = np.argsort(at)
    return at[order], n[order]


def _traverse(shared):
    """One row a document: sums of what the broadcast part settles, and its words that it doesn't hold."""

    def run(batches):
        a = shared.value
        for batch, data, off in K.chunks(batches):
            h, first = tokens(data, off)
            out, p1, w, _ = a.weights(h, first)
            m = batch.num_rows
            row = np.repeat(np.arange(m), np.diff(first))
            rare = np.flatnonzero(w < 0)
            key = _bigrams(h, first)[rare]
            at, tf = _once(row[rare], key)
            at_rows = rare[at]
            cut = np.searchsorted(row[at_rows], np.arange(m + 1)).astype(np.int32)
            lists = pa.StructArray.from_arrays([K.signed(h[at_rows]), K.signed(key[at]), pa.array(tf.astype(np.int32))], ["w", "key", "tf"])
            yield pa.record_batch({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "held": batch.column("held"), "n_tokens": pa.array(np.diff(first).astype(np.int64)),
                "hot_known": pa.array(np.bincount(row, w >= 0, m).astype(np.int64)), "base": pa.array(np.bincount(row, p1, m)),
                "model": pa.array(np.bincount(row, out, m)), "rare": pa.ListArray.from_arrays(pa.array(cut), lists),
            })

    return run


def _open_bigrams(shared, part: int, rounds: int):
    """One round's (row, key, n, tf, kind) for each bigram of a document that isn't frequent and whose word's count n is known; and one row with tf 0 a document."""

    def run(batches):
        a = shared.value
        at_doc = 0
        for batch, data, off in K.chunks(batches):
            h, first = tokens(data, off)
            _, _, w, asked = a.weights(h, first)
            m = batch.num_rows
            row = np.repeat(np.arange(m), np.diff(first))
            asked = np.flatnonzero(asked & (w >= 0))
            key = _bigrams(h, first)[asked]
            mine = K.signed(key).to_numpy() % rounds == part
            asked, key = asked[mine], key[mine]
            at, tf = _once(row[asked], key)
            of = np.append(row[asked[at]], np.arange(m))
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            ids = batch.column("row").to_numpy()
            marks = K.mix(ids.view(np.uint64) + np.arange(at_doc, at_doc + m, dtype=np.uint64))
            at_doc += m
            yield pa.record_batch({
                "row": pa.array(ids[of]), "key": K.signed(np.append(key[at], marks)), "n": pa.array(np.append(a.word_n[w[asked[at]]], np.zeros(m, np.int64))),
                "tf": pa.array(np.append(tf, np.zeros(m, np.int64)).astype(np.int32)), "kind": pa.array(np.where(held[of], 0, TRAIN).astype(np.int32)),
            })

    return run


def _settled(asks: DataFrame, a: Automaton) -> DataFrame:
    """Sums by row of what its questions add to base_score, score and n_known. Equal rows have put theirs each, hence `copies`."""
    seen = F.sum(F.col("tf") * F.col("kind").bitwiseAND(TRAIN)).over(Window.partitionBy("key"))
    p1 = (F.col("n") + 0.1) / F.lit(a.total + 0.1 * (a.distinct + 1))
    own = F.when(F.col("kind") >= RARE, F.col("tf")).otherwise(0)
    copies = F.sum(F.when(F.col("tf") == 0, 1).otherwise(0))
    return asks.withColumn("c", seen).groupBy("row").agg(
        (F.sum(own * F.log10(p1)) / copies).alias("more"),
        (F.sum(F.col("tf") * F.log10(1 + F.col("c") / (p1 * a.mu)) + own * (F.log10(p1) + F.log10(a.mu / (F.col("n") + a.mu)))) / copies).alias("more_model"),
        (F.sum(F.when(F.col("n") > 0, own).otherwise(0)) / copies).cast("long").alias("more_known"),
    )


def lm_score(
    docs: DataFrame, held_out_of: int = 10, held_out_is: int = 0, arcs: int | None = None, hot: int = 262_144, mu: float = 100.0, rounds: int = 4,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Without `arcs`, every word, bigram and trigram of the training texts is in the model; with it, trigrams that make up less than
    1 / `arcs` of the tokens fall back to their bigram (`hot` belongs to that model alone).
    Learns from all rows that are not held out and scores all rows, whole. A-Z are lower-cased; words
    are runs of bytes other than ASCII white space; every text ends with one end token, which is all a
    null or empty text has. base_score is the add-0.1 unigram probability. Repeated rows count and are
    scored each, all alike. A text is never cut, however long; one above 2 MB is a batch of its own. Ties
    don't arise. Other columns are not read. An empty table gives an empty result.
    """
    docs = common.texts(docs, id_col, text_col)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), (common.fold("doc_id", held_out_of) == held_out_is).alias("held"))
    if arcs is None:
        return complete(docs, mu, rounds)
    a, counts = fit(docs.where(~F.col("held")).select("text"), arcs, hot, mu)
    shared = docs.sparkSession.sparkContext.broadcast(a)
    schema = "row long, doc_id long, held boolean, n_tokens long, hot_known long, base double, model double, rare array<struct<w:long,key:long,tf:int>>"
    done = common.store(docs.mapInArrow(_traverse(shared), schema))
    parts = []
    for part in range(rounds):
        asks = docs.mapInArrow(_open_bigrams(shared, part, rounds), "row long, key long, n long, tf int, kind int")
        rare = done.select("row", "held", F.explode("rare").alias("r")).select("row", "held", "r.*").where(F.pmod("key", F.lit(rounds)) == part).join(counts, "w", "left")
        asks = asks.union(rare.select("row", "key", F.coalesce("n", F.lit(0)).alias("n"), "tf", F.when(F.col("held"), RARE).otherwise(RARE + TRAIN).alias("kind")))
        parts.append(common.store(_settled(asks, a)))
    sums = reduce(DataFrame.union, parts).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "more_model", "more_known")))
    return done.drop("rare").join(sums, "row").select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("hot_known") + F.col("more_known")).alias("n_known"),
        F.lit(int(a.total)).cast("long").alias("train_tokens"), (F.col("base") + F.col("more")).alias("base_score"), (F.col("model") + F.col("more_model")).alias("score"),
    )
