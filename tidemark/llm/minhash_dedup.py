"""Near-duplicate documents by MinHash, banding, verification and connected components.

1. One pass gives each document its shingle set's fingerprint, `bands` x `rows` minima of universal
   hashes (a*x + b mod 2**64), folded to band keys, and one byte of each minimum as a signature.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Star round: in each band bucket every class is paired with the bucket's smallest id. Pairs whose
   signatures are far apart (over four standard deviations below the threshold) go; the others are
   confirmed on the full sets. Confirmed pairs give first components.
4. Cross round: in buckets that still hold several components, classes from different components are
   compared unless their shared-shingle counts rule the link out: with c_x of its n_x shingles present
   in another such class, |x & y| <= min(c_x, c_y). Buckets of up to `small` classes give pairs (at
   most `small` a class), checked as above. Larger ones are cut into blocks of `block` classes; a task
   gets two blocks with their full sets, counts all intersections by a product of incidence matrices
   and returns a spanning forest of the links, never pairs.
5. Components of all confirmed links.

A pair inside one component needs no test, since only components are asked for; so a group of m
copies costs m pairs, not m * m. Between components every pair that shares a band is decided. What can
be missed is a pair at the threshold that shares no band (with 24 bands of 6, about one in 86 000 at a
similarity of 0.85, one in 1 500 at 0.8) or that four standard deviations of the signature cut away,
and only if no chain of other links joins it. Sets are equal classes by their size and two 64-bit sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels as K
from tidemark.llm.components import components


def _sets(batch, data, off, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and its sorted distinct shingle hashes."""
    s, e, first = K.words(K.LOWER[data], off)
    h = K.prefix(K.word_hashes(K.LOWER[data], s, e))
    grams = K.windows(h, shingle)
    for i in range(batch.num_rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= shingle:
            yield i, np.unique(grams[a : b - shingle + 1])
        elif b > a:
            yield i, K.mix(K.span(h, np.array([a]), np.array([b])) + np.uint64(b - a))
        else:
            yield i, np.zeros(0, np.uint64)


def _signatures(shingle: int, bands: int, rows: int):
    mul, add = K.seeded(bands * rows, 101) | np.uint64(1), K.seeded(bands * rows, 102)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in K.chunks(batches):
            n, f1, f2, keys, sigs = [], [], [], [], []
            for _, x in _sets(batch, data, off, shingle):
                n.append(len(x))
                f1.append(K.mix(x).sum(dtype=np.uint64))
                f2.append(K.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(x), 512):
                    np.minimum(low, (x[at : at + 512, None] * mul + add).min(axis=0), out=low)
                low = K.mix(low >> np.uint64(24))
                key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
                for r in range(rows):
                    key = K.mix(key * np.uint64(K.BASE) + low[r::rows])
                keys.append(key)
                sigs.append(low.astype(np.uint8).tobytes())
            m = len(n)
            flat = np.concatenate(keys)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()),
                "f1": K.signed(np.array(f1, np.uint64)), "f2": K.signed(np.array(f2, np.uint64)),
                "keys": pa.ListArray.from_arrays(pa.array(np.arange(0, m * bands + 1, bands, dtype=np.int32)), K.signed(flat)),
                "sig": pa.array(sigs, pa.binary()),
            })

    return scan


def _full_sets(shingle: int):
    def scan(batches):
        for batch, data, off in K.chunks(batches):
            sets = [x.tobytes() for _, x in _sets(batch, data, off, shingle)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "words": pa.array(sets, pa.binary())})

    return scan


def _near(least: float):
    """Keep pairs whose signatures agree often enough."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("sig_a").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            y = np.frombuffer(b"".join(b.column("sig_b").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            ok = pa.array((x == y).mean(axis=1) >= least)
            yield pa.record_batch({"a": b.column("a"), "b": b.column("b")}).filter(ok)

    return run


def _confirm(over: int, under: int):
    """Keep pairs with under * |a & b| >= over * |a | b|, on the full sets."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(bool(both) and under * both >= over * (len(x) + len(y) - both))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(ok, pa.bool_()))

    return run


def _forest(over: int, under: int, columns: int = 4096):
    """Links between components within a group of classes: a spanning forest of all of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("doc_id")
        ids, comp, n = rows["doc_id"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in rows["words"]]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        _, slot, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        held = times[slot] > 1
        owner, slot = owner[held], np.unique(slot[held], return_inverse=True)[1]
        order = np.argsort(slot, kind="stable")
        owner, slot = owner[order], slot[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(slot[-1]) + 1 if len(slot) else 0, columns):
            lo, hi = np.searchsorted(slot, (at, at + columns))
            x = np.zeros((len(sets), columns), np.float32)
            x[owner[lo:hi], slot[lo:hi] - at] = 1
            both += x @ x.T
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        linked = (both > 0) & (under * both.astype(np.int64) >= over * (n[:, None] + n[None, :] - both.astype(np.int64)))
        linked &= comp[:, None] != comp[None, :]
        out = []
        for i, j in zip(*np.nonzero(np.triu(linked))):
            p, q = find(int(comp[i])), find(int(comp[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _links(pairs: DataFrame, known: DataFrame, share: Fraction, slack: float) -> DataFrame:
    """The pairs (a, b) of class ids that are linked."""
    at = lambda c, x, y: known.select(F.col("doc_id").alias(c), F.col(x).alias(y))
    near = (
        pairs.join(at("a", "sig", "sig_a"), "a").join(at("b", "sig", "sig_b"), "b")
        .select("a", "b", "sig_a", "sig_b").mapInArrow(_near(float(share) - slack), "a long, b long")
    )
    near = common.cut(near)
    return common.cut(
        near.join(at("a", "words", "set_a"), "a").join(at("b", "words", "set_b"), "b")
        .select("a", "b", "set_a", "set_b")
        .mapInArrow(_confirm(share.numerator, share.denominator), "a long, b long")
    )


def minhash_dedup(
    docs: DataFrame, shingle: int = 5, similarity: str = "0.8", bands: int = 24, rows: int = 6,
    small: int = 64, block: int = 512,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space. A document shorter
    than a shingle has its whole word sequence as its only shingle; one without words (null and
    empty texts) has none, links with nothing and is kept. Repeated rows are copies of each other;
    they share an id, so each of them is returned with the same values. A null id is its own
    component. Ties do not arise: the smallest id stays. Texts of any length are read whole. Other columns
    are not read. An empty table gives an empty result.
    """
    share = Fraction(similarity)
    slack = 4 * (float(share * (1 - share)) / (bands * rows)) ** 0.5
    docs = common.texts(docs, id_col, text_col)
    sigs = common.store(docs.mapInArrow(_signatures(shingle, bands, rows), "doc_id long, n long, f1 long, f2 long, keys array<long>, sig binary"))
    classes = common.cut(sigs.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    reps = sigs.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    buckets = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    shared = common.cut(buckets.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).where("m > 1").select("key", "least"))
    member = common.store(buckets.join(shared, "key"))
    ids = member.select("doc_id").distinct()
    # the hint keeps one plan at every size: the texts of classes that share a bucket, read once more
    sets = docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_full_sets(shingle), "doc_id long, words binary")
    known = reps.select("doc_id", "sig").join(sets.dropDuplicates(["doc_id"]).hint("merge"), "doc_id")
    known = common.store(known)
    stars = member.where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _links(stars, known, share, slack)

    label = common.cut(components(links, "a", "b"))
    placed = member.join(label, member.doc_id == label.node, "left").select("key", "doc_id", "n", F.coalesce("component_id", "doc_id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    placed = common.store(placed.join(common.cut(mixed), "key", "left_semi"))
    each = known.join(placed.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "words").mapInArrow(_exploded, "doc_id long, x long")
    often = common.cut(common.repeated(each.withColumn("n", F.lit(1)), "x"))
    held = common.cut(each.join(often, "x", "left_semi").groupBy("doc_id").agg(F.count("*").alias("c")))
    # |x | y| >= n, so with fewer shared shingles than the similarity's share of n no link is possible
    placed = placed.join(held, "doc_id").where(F.col("c") * share.denominator >= F.col("n") * share.numerator)
    placed = common.store(placed)
    size = common.cut(placed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    placed = placed.join(size, "key")
    p, q = (placed.where(F.col("m") <= small).select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "comp", "c")]) for s in "pq")
    most = F.least("c_p", "c_q")
    cross = p.join(
        q, (p.key == q.key) & (F.col("doc_id_p") < F.col("doc_id_q")) & (F.col("comp_p") != F.col("comp_q"))
        & (most * (share.numerator + share.denominator) >= (F.col("n_p") + F.col("n_q")) * share.numerator),
    ).select(F.col("doc_id_p").alias("a"), F.col("doc_id_q").alias("b")).distinct()
    more = _links(cross, known, share, slack)
    large = placed.where(F.col("m") > small).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "n", "comp")
    large = large.join(known.select("doc_id", "words"), "doc_id").groupBy("key", "i", "j")
    more = more.union(common.cut(large.applyInPandas(_forest(share.numerator, share.denominator), "a long, b long")))
    label = common.cut(components(links.union(more), "a", "b"))

    of = sigs.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left")
    of = of.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    whole = F.coalesce("component_id", "rep", "doc_id")
    return of.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"))


def _exploded(batches):
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
        if sets:
            ids = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(ids), "x": K.signed(np.concatenate(sets))})
