"""Removal of word passages that occur more than once, by level-wise doubling.

Level 1 looks at short windows of half the wanted length. Of the short windows inside each
wanted window only the one with the least hash is looked at (its anchor): equal wanted windows
have equal anchors, so a window whose anchor occurs once cannot repeat. Level 2 extends the
anchors that repeat, and only those, to twice their length: first all wanted windows around an
anchor as one (a class: the anchor's whole surroundings), which repeat whole where the class has
two members; then, for anchors that still have a class of one, each window of each of its classes,
counted with the class's weight. There the doubling ends, as no candidates are left.

Nothing is capped: every window of every document is represented by its anchor at level 1, and by
itself at level 2 if the anchor survives. Counts are summed in map tasks before each shuffle and
the semi-joins are on plain exchanges, so adaptive execution splits a hot passage.

Windows are identified by the 64-bit hash of the anchor plus 64 bits of their own. A text longer than
a chunk is one chunk of its own, so no window is cut. There are no ties: every occurrence goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels as K

MAX_WINDOWS_PER_ANCHOR = 62  # their flags are bits of one long


def _anchor_rows(size: int, keys_only: bool):
    gram = (size + 1) // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in K.chunks(batches):
            s, e, first = K.words(data, off)
            h = K.prefix(K.word_hashes(data, s, e))
            lo, n, at = K.anchors(h, first, size, gram)
            if not len(lo):
                continue
            ah = K.span(h, at, at + gram)
            if keys_only:
                keys, counts = K.combine(ah)
                yield pa.record_batch({"ah": K.signed(keys), "n": pa.array(counts, pa.int64())})
                continue
            cid = K.mix(K.span(h, lo, lo + n - 1 + size) ^ K.mix((n * 64 + at - lo).astype(np.uint64)))
            row = K.rows_of(first, lo)
            yield pa.record_batch({
                "ah": K.signed(ah), "cid": K.signed(cid),
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "lo": pa.array((lo - first[row]).astype(np.int32)),
                "n": pa.array(n.astype(np.int32)),
            })

    return scan


def _window_rows(size: int):
    """The window hashes of each wanted class, read at one member's place in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in K.chunks(batches):
            s, e, first = K.words(data, off)
            h = K.windows(K.prefix(K.word_hashes(data, s, e)), size)
            want = batch.column("want")
            w, row = want.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(want.offsets.to_numpy()))
            n = w.field("n").to_numpy().astype(np.int64)
            if not len(n):
                continue
            ends = np.cumsum(n)
            each = np.repeat(first[row] + w.field("lo").to_numpy() - ends + n, n) + np.arange(ends[-1])
            wins = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), K.signed(h[each]))
            yield pa.record_batch({"ah": w.field("ah"), "cid": w.field("cid"), "n": w.field("times"), "wins": wins})

    return run


def repeated_windows(docs: DataFrame, min_words: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `marks`: (lo, mask) pairs; bit i of mask says that the window at word lo + i repeats."""
    if not 2 <= min_words <= 2 * MAX_WINDOWS_PER_ANCHOR:
        raise ValueError(f"min_words must be 2 to {2 * MAX_WINDOWS_PER_ANCHOR}")
    docs = common.texts(docs, id_col, text_col)
    level1 = common.cut(common.repeated(docs.mapInArrow(_anchor_rows(min_words, True), "ah long, n long"), "ah"))
    found = docs.mapInArrow(_anchor_rows(min_words, False), "ah long, cid long, doc_id long, lo int, n int")
    found = common.store(found.join(level1, "ah", "left_semi"))
    classes = found.groupBy("ah", "cid").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "lo")).alias("at"), F.first("n").alias("n"))
    classes = common.store(classes.select("ah", "cid", "times", "at.doc_id", "at.lo", "n"))
    unsure = classes.groupBy("ah").agg(F.count("*").alias("m"), F.min("times").alias("least")).where("m > 1 and least = 1")
    want = classes.join(common.cut(unsure.select("ah")), "ah").groupBy("doc_id").agg(F.collect_list(F.struct("ah", "cid", "times", "lo", "n")).alias("want"))
    # the hint keeps one plan at every size
    each = docs.join(want.hint("merge"), "doc_id").mapInArrow(_window_rows(min_words), "ah long, cid long, n long, wins array<long>")
    each = common.store(each.dropDuplicates(["ah", "cid"])).select("ah", "cid", "n", F.posexplode("wins").alias("i", "w"))
    level2 = common.cut(common.repeated(each, "ah", "w"))
    masks = (
        each.where("n = 1").join(level2, ["ah", "w"], "left_semi")
        .groupBy("ah", "cid")
        .agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask"))
    )
    masks = common.cut(masks.union(classes.where("times > 1").select("ah", "cid", F.expr("shiftleft(1L, n) - 1").alias("mask"))))
    return (
        found.select("ah", "cid", "doc_id", "lo").join(masks, ["ah", "cid"])
        .groupBy("doc_id").agg(F.collect_list(F.struct("lo", "mask")).alias("marks"))
    )


def _starts(marks, base: int) -> np.ndarray:
    """Window starts of a row's (lo, mask) pairs."""
    lo = marks.field("lo").to_numpy(zero_copy_only=False).astype(np.int64)
    mask = marks.field("mask").to_numpy(zero_copy_only=False).astype(np.int64)
    bits = (mask[:, None] >> np.arange(63)) & 1
    at, i = np.nonzero(bits)
    return lo[at] + i + base


def _apply(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in K.chunks(batches):
            s, e, first = K.words(data, off)
            marks, n_removed, digests, kept_texts = batch.column("marks"), [], [], []
            marked = marks.is_valid().to_numpy(zero_copy_only=False)
            raw = data.tobytes()
            for i in range(batch.num_rows):
                a, b = int(first[i]), int(first[i + 1])
                keep = np.ones(b - a, bool)
                if marked[i]:
                    cover = np.zeros(b - a + 1, np.int64)
                    at = _starts(marks[i].values, 0)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                text = b" ".join([raw[x:y] for x, y in zip(s[a:b][keep].tolist(), e[a:b][keep].tolist())])
                n_removed.append(int((~keep).sum()))
                digests.append(hashlib.sha256(text).hexdigest())
                kept_texts.append(text.decode("utf-8", "replace"))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(first).astype(np.int64)),
                "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests), "kept_text": pa.array(kept_texts, pa.string()),
            })

    return run


def substring_dedup(docs: DataFrame, min_words: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space).

    Words are runs of bytes other than ASCII white space. Null and empty texts have no words and
    keep the empty text. Every occurrence of a repeated window goes, the first one too. Repeated
    rows are copies of each other. Rows need an id; one without keeps all its words, but
    counts for the others. Other columns
    of `docs` are not read. An empty table gives an empty result.
    """
    docs = common.keyed(common.texts(docs, id_col, text_col))
    marks = repeated_windows(docs, min_words)
    joined = docs.join(marks, "doc_id", "left").select(F.col("own_id").alias("doc_id"), "text", F.when(F.col("own_id").isNotNull(), F.col("marks")).alias("marks"))
    return joined.mapInArrow(_apply(min_words), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
