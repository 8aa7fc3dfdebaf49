"""Importance resampling towards a target distribution, over hashed word n-grams.

Within each piece of text (at most `PIECE` words, so memory is bounded whatever a text's length) the
distinct words get integer ids from Arrow's dictionary encoding. An n-gram is a tuple of ids, kept as the
pair (id of its first n - 1 words' tuple, id of its last word). Each distinct tuple of the piece is turned
back into its bytes and hashed once (crc32 runs on from its first n - 1 words' value to the last word's bytes); the bucket, or what it is worth, is joined back to all the tuple's
occurrences through the inverse index. The dictionary belongs to the piece: one of the whole corpus would
have to shuffle every distinct n-gram, nearly as many rows as there are words, to save a hash of some 20 bytes.

Pass one counts buckets (sums of a piece leave a task as at most `buckets` numbers); pass two gives each
document the sum of its buckets' gains, a table of `buckets` numbers, so a broadcast of fixed size. Ranks come
from one range exchange: rows sorted across partitions, numbered within them, and offset by the rows of
the partitions before. Nothing is gathered in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels as K

PIECE = 1 << 19
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tuples(words: pa.Array, row: np.ndarray, n: int, buckets: int):
    """For each length 1..n: (starts, which, bucket): where its n-grams start, which distinct tuple each is, and each tuple's bucket."""
    coded = words.dictionary_encode()
    ids, said = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    more = [b" " + w for w in said]
    starts, which, hashes = np.arange(len(ids)), ids, list(map(zlib.crc32, said))
    yield starts, which, np.array(hashes, np.int64) % buckets
    for k in range(2, n + 1):
        live = starts + k - 1 < len(ids)
        starts, which = starts[live], which[live]
        same = row[starts] == row[starts + k - 1]
        starts, which = starts[same], which[same]
        coded = pa.array(which * len(said) + ids[starts + k - 1]).dictionary_encode()
        pairs, which = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        head, tail = (pairs // max(len(said), 1)).tolist(), (pairs % max(len(said), 1)).tolist()
        hashes = list(map(zlib.crc32, map(more.__getitem__, tail), map(hashes.__getitem__, head)))
        yield starts, which, np.array(hashes, np.int64) % buckets


def pieces(data: np.ndarray, off: np.ndarray, n: int):
    """(words, row of each word, how many start here) of lower-cased text, cut at `PIECE` words with n - 1 words of overlap."""
    low = K.LOWER[data]
    s, e, first = K.words(low, off, LETTERS)
    row = K.rows_of(first, np.arange(len(s)))
    for at in range(0, len(s), PIECE):
        to = min(at + PIECE + n - 1, len(s))
        a, b = s[at:to], e[at:to]
        size = np.zeros(to - at + 1, np.int32)
        np.cumsum(b - a, out=size[1:])
        flat = low[a[0] : b[-1]]
        flat = flat[LETTERS[flat]]
        yield pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(size), pa.py_buffer(flat)]), row[at:to], min(PIECE, len(s) - at)


def _counted(n: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, data, off in K.chunks(batches):
            for words, row, own in pieces(data, off, n):
                for starts, which, bucket in tuples(words, row, n, buckets):
                    seen = np.bincount(which[starts < own], minlength=len(bucket))
                    total += np.bincount(bucket, seen, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(some), "n": pa.array(total[some])})

    return run


def counts(rows: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    sums = rows.select("text").mapInArrow(_counted(n, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the corpus."""
    s, t, m = have.astype(float), want.astype(float), float(len(have))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + m) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def _weighed(shared, n: int):
    def run(batches):
        gain = shared.value
        for batch, data, off in K.chunks(batches):
            many, worth, length = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for words, row, own in pieces(data, off, n):
                length += np.bincount(row[:own], minlength=batch.num_rows)
                for starts, which, bucket in tuples(words, row, n, len(gain)):
                    mine = starts < own
                    at = row[starts[mine]]
                    many += np.bincount(at, minlength=batch.num_rows)
                    worth += np.bincount(at, gain[bucket][which[mine]], batch.num_rows).astype(np.int64)  # whole numbers, exact below 2 ** 53
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(length), "n_features": pa.array(many), "weight": pa.array(worth)})

    return run


def resample(
    docs: DataFrame, target: DataFrame, share: int = 5, n: int = 3, buckets: int = 10_000, min_words: int = 20, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank.

    Of the N documents with at least `min_words` words the floor(share * N / 100) highest scores are drawn and
    ranked from 1, ties going to the smaller doc_id; the others' rank is null. The score is the weight plus Gumbel noise
    from the id's hash, so the draw is without replacement and can be repeated.

    Null and empty texts have no words, features or weight and are never drawn. Repeated rows count and are ranked each; a
    null id hashes as the empty text and loses ties. Texts of any length are read whole, also in an empty target, which
    leaves one gain for all unseen buckets. Other columns are not read. An empty table gives an empty result.
    """
    rows = common.texts(docs, id_col, text_col)
    want = target.select(F.col(target_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(gains(counts(rows, n, buckets), counts(want, n, buckets)))
    out = rows.mapInArrow(_weighed(shared, n), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    out = common.store(out.withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= min_words
    ordered = common.store(out.orderBy(able.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features").withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r._part: (r.n, r.m) for r in ordered.groupBy(part).agg(F.count("*").alias("n"), F.count_if(able).alias("m")).collect()}  # one row a partition
    before, drawn = 0, share * sum(m for _, m in sizes.values()) // 100
    offsets = []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p][0]
    offsets = docs.sparkSession.createDataFrame(offsets, "_part long, _before long")
    rank = F.col("_before") + place + 1
    out = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(able & (rank <= drawn), rank).alias("rank"))
