"""The complete trigram automaton of `lm_score`: every n-gram of the training texts is a state or an arc, none is left out.

With p2 as in `lm_score`, a state (u, v) has an arc for each trigram seen,
    p3(w | u, v) = (c(u, v, w) + mu * p2(w | v)) / (c(u, v) + mu),
and for other words a failure arc to v that weighs mu / (c(u, v) + mu). As every bigram that doesn't end a text
is followed by some word, its arcs and its failure arc sum to one.

The automaton is never in one place. Texts are tokenised once and stored in pieces of about 2 MB (or one longer text). A piece
puts each of its distinct words, bigrams and trigrams once to the bucket of its hash, with the number of times that its training
texts hold it; a bucket adds up and returns the sums to the pieces in the order asked, so a piece gets the
part of the automaton that its texts can reach and walks them through it. A hot n-gram is asked once a piece, and there
are as many buckets as keep each near `BUCKET` questions. They go in `rounds` rounds by bucket, one of them on disk at a time, and
the pieces meet their answers in as many rounds by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels as K

END = int(K.mix(np.array([12345], np.uint64))[0])
BUCKET = 1 << 20
TRIGRAM = 0xD6E8FEB86659FD93
PIECES = "piece long, doc_ids array<long>, held array<boolean>, n_tokens array<long>, n_train long, words binary, tokens binary"


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by END, and the n + 1 token offsets."""
    low = K.LOWER[data]
    s, e, first = K.words(low, off)
    h = np.insert(K.word_hashes(low, s, e), first[1:], np.uint64(END))
    return h, first + np.arange(len(first))


def before(x: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """Each token's value of the token before it; `start` for the first of a row."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first[:-1]] = start
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch, data, off in K.chunks(batches):
        h, first = tokens(data, off)
        words, which = np.unique(h, return_inverse=True)
        held, n = batch.column("held").to_numpy(zero_copy_only=False).astype(bool), np.diff(first)
        row = {
            "piece": [number], "doc_ids": [batch.column("doc_id").to_pylist()], "held": [held.tolist()], "n_tokens": [n.tolist()], "n_train": [int(n[~held].sum())],
            "words": [words.tobytes()], "tokens": [which.astype("<u2" if len(words) <= 1 << 16 else "<u4").tobytes()],
        }
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
        yield pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(row.items(), kinds)})
        number += 1


class Piece:
    """A stored piece's tokens and the places of their words, bigrams and trigrams among its distinct n-grams.

    The first token of a row has END before it and no trigram; `inner` marks the others."""

    def __init__(self, row: dict):
        words = np.frombuffer(row["words"], "<u8")
        self.n_tokens = np.array(row["n_tokens"], np.int64)
        self.held = np.array(row["held"], bool)
        first = np.append(0, np.cumsum(self.n_tokens))
        self.word = np.frombuffer(row["tokens"], f"<u{len(row['tokens']) // max(first[-1], 1)}").astype(np.int64)
        self.n = n = len(words)
        self.last = before(self.word, first, np.searchsorted(words, np.uint64(END)))
        pairs, self.pair = np.unique(self.last * n + self.word, return_inverse=True)
        self.state = before(self.pair, first, 0)
        self.inner = np.ones(len(self.word), bool)
        self.inner[first[:-1]] = False
        triples, self.triple = np.unique(self.state[self.inner] * n + self.word[self.inner], return_inverse=True)
        with np.errstate(over="ignore"):
            two = K.mix(words[pairs // n] * np.uint64(K.BASE) + words[pairs % n])
            three = K.mix(two[triples // n] * np.uint64(TRIGRAM) + words[triples % n])
        self.sizes = n, len(pairs), len(triples)
        self.key = np.concatenate([words, two, three]) & ~np.uint64(1)
        self.key[:n] |= np.uint64(1)  # tells words

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams in the order of their buckets, and where each bucket begins in it (one more for the end)."""
        bucket = ((self.key >> np.uint64(1)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        return np.argsort(bucket, kind="stable"), np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))

    def counts(self) -> np.ndarray:
        """How often the piece's training texts hold each n-gram."""
        own = np.repeat(~self.held, self.n_tokens)
        seen = self.word[own], self.pair[own], self.triple[own[self.inner]]
        return np.concatenate([np.bincount(s, minlength=m) for s, m in zip(seen, self.sizes)])

    def walked(self, c: np.ndarray, total: int, distinct: int, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By row: tokens known, and log10 of the root's and of the automaton's weights along the row's path."""
        c1, c2, c3 = np.split(c.astype(float), np.cumsum(self.sizes)[:2])
        p1 = (c1 + 0.1) / (total + 0.1 * (distinct + 1))
        p = (c2[self.pair] + mu * p1[self.word]) / (c1[self.last] + mu)
        p[self.inner] = (c3[self.triple] + mu * p[self.inner]) / (c2[self.state[self.inner]] + mu)
        row, m = np.repeat(np.arange(len(self.n_tokens)), self.n_tokens), len(self.n_tokens)
        return np.bincount(row, c1[self.word] > 0, m).astype(np.int64), np.bincount(row, np.log10(p1)[self.word], m), np.bincount(row, np.log10(p), m)


def _questions(buckets: int, lo: int, hi: int):
    """(bucket, piece, keys, n): the distinct n-grams of each piece in the buckets lo to hi - 1, with their counts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                p = Piece(row)
                order, cut = p.dealt(buckets)
                mine, off = order[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo]
                out = pa.record_batch({
                    "bucket": pa.array(np.arange(lo, hi, dtype=np.int32)), "piece": pa.array(np.full(hi - lo, row["piece"])),
                    "keys": _binary(p.key[mine].astype("<u8"), off), "n": _binary(p.counts()[mine].astype("<u4"), off),
                })
                yield out.filter(pa.array(np.diff(off) > 0))

    return run


def _binary(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _values(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column without nulls, and where each row's begin (one more for the end)."""
    parts = [(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64), c.buffers()[2]) for c in column.chunks if len(c)]
    values = np.concatenate([np.frombuffer(data, np.uint8)[off[0] : off[-1]] for off, data in parts]).view(kind)
    return values, np.append(0, np.cumsum(np.concatenate([np.diff(off) for off, _ in parts]))) // values.itemsize


def _answers(questions: pa.Table) -> pa.Table:
    """(piece, bucket, n, distinct): the sums of a bucket's keys for each piece, in its order; and, on one row, how many words it trained."""
    keys, off = _values(questions["keys"], "<u8")
    n, _ = _values(questions["n"], "<u4")
    known, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, n, len(known))  # whole numbers below 2 ** 53
    wide = "<u4" if total.max() < 1 << 32 else "<u8"
    distinct = np.zeros(len(off) - 1, np.int64)
    distinct[0] = np.count_nonzero((known & np.uint64(1) == 1) & (total > 0))
    return pa.table({"piece": questions["piece"], "bucket": questions["bucket"], "n": _binary(total.astype(wide)[at], off), "distinct": pa.array(distinct)})


def _scores(buckets: int, total: int, distinct: int, mu: float):
    def run(piece: pa.Table, answers: pa.Table) -> pa.Table:
        row = piece.slice(0, 1).to_pylist()[0]
        p = Piece(row)
        order, cut = p.dealt(buckets)
        c = np.zeros(len(order))
        for b, n in zip(answers["bucket"].to_pylist(), answers["n"].to_pylist()):
            c[order[cut[b] : cut[b + 1]]] = np.frombuffer(n, f"<u{len(n) // int(cut[b + 1] - cut[b])}")
        known, base, score = p.walked(c, total, distinct, mu)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(p.held), "n_tokens": pa.array(p.n_tokens), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(known), total, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
        })

    return run


def complete(docs: DataFrame, mu: float, rounds: int) -> DataFrame:
    """`lm_score` of (doc_id, text, held) by the complete automaton."""
    pieces = common.store(docs.select("doc_id", "text", "held").mapInArrow(_pieces, PIECES))
    size, total = pieces.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x), F.col("n_train")))).first()
    buckets = max(1, -(-2 * size // BUCKET))  # a piece repeats about a third of its n-grams
    answers = []
    for part in range(rounds):
        lo, hi = buckets * part // rounds, buckets * (part + 1) // rounds
        if lo < hi:
            asked = pieces.mapInArrow(_questions(buckets, lo, hi), "bucket int, piece long, keys binary, n binary")
            answers.append(common.store(asked.groupBy("bucket").applyInArrow(_answers, "piece long, bucket int, n binary, distinct long")))
    answers = reduce(DataFrame.union, answers)
    distinct = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = []
    for part in range(rounds):
        mine = F.pmod(F.xxhash64("piece"), F.lit(rounds)) == part
        both = pieces.where(mine).groupBy("piece").cogroup(answers.where(mine).select("piece", "bucket", "n").groupBy("piece"))
        scored.append(common.store(both.applyInArrow(_scores(buckets, total, distinct, mu), schema)))
    return reduce(DataFrame.union, scored)
