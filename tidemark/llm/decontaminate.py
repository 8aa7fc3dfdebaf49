"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

A region within e edits of a passage of m characters shares at least m - q + 1 - q*e of its q-grams,
all on diagonals (place in the document minus place in the passage) that span at most e. Diagonals
are cut into bands of e + 1; each hit counts for two overlapping bands, so one band holds all of a
region's hits. Bands that reach the bound are aligned with the passage, within the band widened by
e on each side; those within e edits are matches.

A lemma for e edits needs q-grams of at most m / (e + 1) characters, so shorter passages use shorter
q-grams: passages are indexed in groups of one q, and none is left out or compared with fewer edits.

Characters are the UTF-8 bytes of the text, A-Z lower-cased, ASCII white space as a space. The
passages' q-grams are broadcast in blocks of at most `block_bytes` of passage text, one pass over the
documents for each block; documents are never shuffled for the search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels as K

FOLD = K.LOWER.copy()
FOLD[[*range(0x09, 0x0E)]] = 0x20
FILTER_BITS = 22
HITS = 1 << 22


@dataclass
class Index:
    """Passages and their q-grams: sorted distinct hashes, and where each occurs."""

    q: int
    ids: np.ndarray
    text: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray


def index(ids: np.ndarray, passages: list[str], q: int, rate: float) -> list[Index]:
    """The passages in groups of equal q-gram length: q, or less where their length and edits ask for it."""
    text = [FOLD[np.frombuffer(p.encode(), np.uint8)] for p in passages]
    m = np.array([len(t) for t in text], np.int64)
    edits = (m * rate).astype(np.int64)
    own = np.minimum(q, m // (edits + 1))
    out = []
    for k in np.unique(own).tolist():
        use = np.flatnonzero(own == k)
        hashes, item, place = [], [], []
        for j, i in enumerate(use.tolist()):
            g = K.windows(K.prefix(K.BYTE_VALUES[text[i]]), k)
            hashes.append(g)
            item.append(np.full(len(g), j))
            place.append(np.arange(len(g)))
        h, item, place = np.concatenate(hashes), np.concatenate(item), np.concatenate(place)
        order = np.argsort(h, kind="stable")
        grams, begin = np.unique(h[order], return_index=True)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        out.append(Index(k, ids[use], [text[i] for i in use], edits[use], m[use] - k + 1 - k * edits[use], grams, np.append(begin, len(h)), item[order], place[order], seen))
    return out


def align(item: np.ndarray, m: np.ndarray, region: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole item against any stretch of its region, and the diagonal it ends on.

    item: (c, longest) characters, m: lengths; region: (c, longest + width); all rows at once.
    """
    k = np.arange(width, dtype=np.int32)
    row = np.zeros((len(m), width), np.int32)
    big = np.full((len(m), 1), 1 << 20, np.int32)
    for i in range(item.shape[1]):
        new = np.minimum(row + (region[:, i : i + width] != item[:, i : i + 1]), np.hstack([row[:, 1:], big]) + 1)
        new = np.minimum.accumulate(new - k, axis=1) + k
        row = np.where((i < m)[:, None], new, row)
    at = row.argmin(axis=1)
    return row[np.arange(len(m)), at], at


def _bands(x: Index, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(row, item, band) triples that reach the lemma's bound."""
    q = x.q
    g = K.windows(K.prefix(K.BYTE_VALUES[data]), q)
    at = np.flatnonzero(x.seen[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    u = K.find(x.grams, g[at])
    at, u = at[u >= 0], u[u >= 0]
    row = K.rows_of(off, at)
    whole = at + q <= off[row + 1]
    at, u, row = at[whole], u[whole], row[whole]
    keys, counts = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    times = x.begin[u + 1] - x.begin[u]
    total = np.cumsum(times)
    lo = 0
    while lo < len(at):  # bounded pieces of the expanded hits
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HITS, "right")))
        n = times[lo:hi]
        post = np.repeat(x.begin[u[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        it = x.item[post]
        r = np.repeat(row[lo:hi], n)
        band = (np.repeat(at[lo:hi] - off[row[lo:hi]], n) - x.place[post]) // (x.edits[it] + 1)
        packed = (((r * len(x.ids)) + it) << 32) | (band + (1 << 31))
        key, c = np.unique(packed, return_counts=True)
        keys.append(np.stack([key >> 32, (key & 0xFFFFFFFF) - (1 << 31), np.zeros_like(key)], 1))
        counts.append(c)
        lo = hi
    key = np.concatenate(keys)
    packed, inverse = np.unique((key[:, 0] << 32) | (key[:, 1] + (1 << 31)), return_inverse=True)
    count = np.bincount(inverse, np.concatenate(counts), len(packed)).astype(np.int64)
    cand = np.unique(np.concatenate([packed, packed - 1]))  # band b with b + 1
    here = lambda k: np.where((i := K.find(packed, k)) >= 0, count[i] if len(count) else 0, 0)
    pair = cand >> 32
    good = here(cand) + here(cand + 1) >= x.bound[pair % max(1, len(x.ids))] if len(cand) else np.zeros(0, bool)
    pair, band = pair[good], (cand[good] & 0xFFFFFFFF) - (1 << 31)
    return np.stack([pair // max(1, len(x.ids)), pair % max(1, len(x.ids)), band], 1) if len(pair) else np.zeros((0, 3), np.int64)


def _aligned(x: Index, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of the bands that hold the item within its edits."""
    found = _bands(x, data, off)
    for at in range(0, len(found), 256):
        part = found[at : at + 256]
        e = x.edits[part[:, 1]]
        m = np.array([len(x.text[i]) for i in part[:, 1]])
        first = part[:, 2] * (e + 1) - e
        width = int((4 * e + 2).max())
        item = np.zeros((len(part), m.max()), np.uint8)
        region = np.zeros((len(part), m.max() + width), np.uint8)
        for j, (r, i, _) in enumerate(part):
            item[j, : m[j]] = x.text[i]
            lo, hi = off[r] + first[j], min(off[r] + first[j] + m[j] + width, off[r + 1])
            skip = max(0, -int(first[j]))
            piece = data[lo + skip : hi]
            region[j, skip : skip + len(piece)] = piece
        edits, diagonal = align(item, m, region, width)
        for j in np.flatnonzero(edits <= e):
            end = int(first[j] + diagonal[j] + m[j])
            yield int(part[j, 0]), int(x.ids[part[j, 1]]), max(0, end - int(m[j])), end, int(edits[j])


def _search(shared):
    def run(batches):
        for batch, raw, off in K.chunks(batches):
            data = FOLD[raw]
            hits = sorted(h for x in shared.value for h in _aligned(x, data, off))
            if hits:
                r, i, s, t, d = zip(*hits)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").take(pa.array(r)), "item_id": pa.array(i, pa.int64()),
                    "start": pa.array(s, pa.int64()), "end": pa.array(t, pa.int64()), "edits": pa.array(d, pa.int32()),
                })

    return run


def matches(docs: DataFrame, benchmark: DataFrame, q: int = 10, max_edit_rate: float = 0.08, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, start, end, edits) of all regions, in bytes; regions of neighbouring bands may repeat."""
    docs = common.texts(docs, id_col, text_col)
    parts = [docs.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(x)), "doc_id long, item_id long, start long, end long, edits int") for x in indexes(benchmark, q, max_edit_rate, block_bytes, item_col, text_col)]
    return reduce(DataFrame.union, parts)


def indexes(benchmark: DataFrame, q: int, max_edit_rate: float, block_bytes: int, item_col: str = "item_id", text_col: str = "text") -> list:
    """The passages' indexes, one for each part of about `block_bytes` of them."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and length(text) > 0")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    out = []
    for b in range(blocks):
        t = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        out.append(index(t.column("item_id").to_numpy(), t.column("text").to_pylist(), q, max_edit_rate))
    return out


def _told(shared):
    def run(batches):
        for batch, raw, off in K.chunks(batches):
            data, items = FOLD[raw], [set() for _ in range(batch.num_rows)]
            for x in shared.value:
                for r, i, *_ in _aligned(x, data, off):
                    items[r].add(i)
            yield pa.record_batch({**{c: batch.column(c) for c in ("row", "doc_id", "text_sha256")}, "items": pa.array([sorted(i) for i in items], pa.list_(pa.int64()))})

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = 10, max_edit_rate: float = 0.08, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_items (passages found in it), items (their sorted ids), contaminated, text_sha256.

    A passage of any length is found where a region is within floor(max_edit_rate * its length) edits of
    it. Null and empty texts, null and empty passages, and an empty benchmark, give no match. Repeated
    passages are found each, equally near regions each too. Every row is told by its own text, also where an id is
    repeated or null. Texts are searched whole, a text longer than a chunk as a chunk of its own. Other
    columns are not read. A benchmark above `block_bytes` is searched for in several passes, whose answers meet by row.
    """
    rows = common.texts(docs, id_col, text_col)
    parts = indexes(benchmark, q, max_edit_rate, block_bytes)
    if len(parts) > 1:
        rows = common.keyed(rows).select(F.col("own_id").alias("doc_id"), "text", F.col("doc_id").alias("row"))
    else:
        rows = rows.withColumn("row", F.lit(0).cast("long"))
    rows = rows.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    told = [rows.mapInArrow(_told(rows.sparkSession.sparkContext.broadcast(x)), "row long, doc_id long, text_sha256 string, items array<long>") for x in parts]
    out = told[0]
    if len(told) > 1:
        out = reduce(DataFrame.union, told).groupBy("row", "doc_id", "text_sha256").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    return out.select("doc_id", F.size("items").cast("long").alias("n_items"), "items", (F.size("items") > 0).alias("contaminated"), "text_sha256")
