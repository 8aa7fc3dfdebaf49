"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of `size` bytes starts at every byte. Of the short pieces inside it the one with the least
hash names its anchor; equal strings have equal anchors at equal places. So:

1. Anchors whose piece occurs once are dropped; a string around them cannot repeat.
2. The strings that share an anchor place form its context, one stretch of text. Equal contexts are a
   class; a class with two members repeats as a whole. Classes are told apart by a 128-bit BLAKE2 digest
   of the context's bytes, not by the polynomial hashes, whose collisions are easy to build.
3. Where an anchor has classes with one member, all its classes are compared: their suffixes from the
   anchor on are merge-sorted. Suffixes are compared by prefix polynomial hashes: binary search finds
   the common extension, the byte after it decides, so a comparison costs a logarithm of the length.
   Neighbours' common extensions give those of all pairs as running minima; the extension to the left
   is searched the same way; together they give the strings that two contexts share. Each such match
   is confirmed on the bytes before it counts.
4. An anchor with more than `group` classes is dealt to several sorts by a hash; what each leaves
   unmatched, and one of each string it matched, meets by the digests of the strings' bytes.

A place that occurs in both of a pair's contexts, or a text compared with itself at another place, is a
repeat like any other: ties don't arise, as every occurrence goes. Texts longer than a chunk are one
chunk of their own, so a string across a chunk's edge is never lost.

Nothing is capped or sampled away, copies are pre-aggregated as classes, and only step 3 moves text:
one context per class of unresolved anchors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels as K


def _digest(text: bytes, back: int = 0) -> bytes:
    """Of a context's bytes and the place of its anchor."""
    return hashlib.blake2b(text, digest_size=16, salt=back.to_bytes(8, "little")).digest()


def _anchors(size: int, gram: int, keys_only: bool):
    def run(batches):
        for batch, data, off in K.chunks(batches):
            h = K.prefix(K.BYTE_VALUES[data])
            lo, n, at = K.anchors(h, off, size, gram)
            if not len(lo):
                continue
            ah = K.span(h, at, at + gram)
            if keys_only:
                k, c = K.combine(ah)
                yield pa.record_batch({"ah": K.signed(k), "n": pa.array(c, pa.int64())})
                continue
            raw, row = data.tobytes(), K.rows_of(off, lo)
            cid = [_digest(raw[a : a + k - 1 + size], b) for a, k, b in zip(lo.tolist(), n.tolist(), (at - lo).tolist())]
            yield pa.record_batch({
                "ah": K.signed(ah), "cid": pa.array(cid, pa.binary()), "doc_id": batch.column("doc_id").take(pa.array(row)),
                "lo": pa.array(lo - off[row]), "n": pa.array(n.astype(np.int32)), "back": pa.array((at - lo).astype(np.int32)),
            })

    return run


def _contexts(size: int):
    """The text of each wanted context: rows hold a document and its list of contexts."""

    def run(batches):
        for batch, data, off in K.chunks(batches):
            raw, out = data.tobytes(), []
            for i, want in enumerate(batch.column("want").to_pylist()):
                for w in want:
                    a = int(off[i]) + w["lo"]
                    out.append((w["ah"], w["cid"], w["n"], w["back"], w["many"], w["salts"], raw[a : a + w["n"] - 1 + size]))
            if out:
                cols = list(zip(*out))
                yield pa.record_batch({c: pa.array(v, t) for c, v, t in zip(("ah", "cid", "n", "back", "many", "salts", "ctx"), cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()))})

    return run


def extension(h: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Length of the common extension of places p and q, to the right (step 1) or the left (-1), up to `most`."""
    lo, hi = np.zeros(len(p), np.int64), most.astype(np.int64).copy()
    if not len(p):
        return lo
    inv = K.powers(K.INVERSE, len(h))
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) >> 1
        a, b = (p, q) if step > 0 else (p - mid, q - mid)
        same = (h[a + mid] - h[a]) * inv[a] == (h[b + mid] - h[b]) * inv[b]
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def _less(h, data, place, end, x, y) -> np.ndarray:
    """Whether suffix x comes strictly before suffix y (numbers into place and end)."""
    p, q = place[x], place[y]
    most = np.minimum(end[x] - p, end[y] - q)
    e = extension(h, p, q, most, 1)
    whole = e == most
    a = data[np.minimum(p + e, len(data) - 1)]
    b = data[np.minimum(q + e, len(data) - 1)]
    return np.where(whole, end[x] - p < end[y] - q, a < b)


def suffix_sort(h: np.ndarray, data: np.ndarray, place: np.ndarray, end: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Numbers of the suffixes data[place:end], sorted within their buckets (given in order): a bottom-up
    mergesort in which all runs of a level are merged at once, by binary search in the sibling run."""
    n = len(place)
    order = np.arange(n)
    first = np.searchsorted(bucket, bucket, "left")
    count = np.searchsorted(bucket, bucket, "right") - first
    rel = np.arange(n) - first
    width, longest = 1, int(count.max()) if n else 0
    while width < longest:
        run = rel // width
        left = run % 2 == 0
        lo = first + np.where(left, run + 1, run - 1) * width  # the sibling run
        hi = np.minimum(lo + width, first + count)
        lo = np.minimum(lo, hi)
        a, b = lo.copy(), hi.copy()
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                break
            mid = (a[live] + b[live]) >> 1
            x, y = order[live], order[mid]
            go = np.where(left[live], _less(h, data, place, end, y, x), ~_less(h, data, place, end, x, y))
            a[live] = np.where(go, mid + 1, a[live])
            b[live] = np.where(go, b[live], mid)
        to = first + (run - run % 2) * width + rel % width + (a - lo)
        new = np.empty_like(order)
        new[to] = order
        order, width = new, width * 2
    return order


def _compare(size: int):
    """Rows are anchors with the list of their classes; returns for each class the runs of its strings
    that repeat, and for dealt-out anchors the hashes of its other strings and of one of each repeated."""

    def run(batches):
        for batch in batches:
            groups = batch.column("classes")
            sizes = np.diff(groups.offsets.to_numpy())
            flat, start = groups.flatten(), 0
            text = flat.field("ctx")
            bytes_ = np.append(0, np.cumsum(pa.compute.binary_length(text).to_numpy(zero_copy_only=False)))
            ends = np.cumsum(sizes)
            ah, salts = batch.column("ah").to_pylist(), batch.column("salts").to_numpy()
            g = 0
            while g < len(sizes):
                e = g + 1
                while e < len(sizes) and bytes_[ends[e]] - bytes_[start] <= K.CHUNK:
                    e += 1
                stop = int(ends[e - 1])
                yield from _sorted_matches(size, flat.slice(start, stop - start), sizes[g:e], ah[g:e], salts[g:e])
                g, start = e, stop

    return run


def _sorted_matches(size, flat, sizes, ah, salts):
    ctx = flat.field("ctx").to_pylist()
    n, back = flat.field("n").to_numpy().astype(np.int64), flat.field("back").to_numpy().astype(np.int64)
    cid, many = flat.field("cid"), flat.field("many").to_numpy(zero_copy_only=False)
    length = np.array([len(c) for c in ctx], np.int64)
    data = np.frombuffer(b"".join(ctx), np.uint8)
    begin = np.append(0, np.cumsum(length))
    h = K.prefix(K.BYTE_VALUES[data])
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    place, end = begin[:-1] + back, begin[1:]
    order = suffix_sort(h, data, place, end, bucket)
    p, stop, b = place[order], end[order], bucket[order]
    near = np.zeros(len(order), np.int64)  # common extension with the one before
    same = np.flatnonzero(b[1:] == b[:-1]) + 1
    near[same] = extension(h, p[same - 1], p[same], np.minimum(stop[same - 1] - p[same - 1], stop[same] - p[same]), 1)
    base = np.append(0, np.cumsum(n))
    hit = np.zeros(int(n.sum()), bool)
    hit[np.repeat(many, n)] = True
    # a pair's strings lie within its common extensions: to the left at most as far as the longest way back in the bucket
    reach = np.zeros(len(sizes), np.int64)
    np.maximum.at(reach, bucket, back)
    right, i, delta = np.full(len(order), 1 << 40), np.arange(len(order)), 0
    while True:
        delta += 1
        i = i[i + delta < len(order)]
        i = i[b[i] == b[np.minimum(i + delta, len(order) - 1)]]
        if not len(i):
            break
        right[i] = np.minimum(right[i], near[i + delta])
        i = i[right[i] + reach[b[i]] >= size]  # the running minimum only falls
        x, y, r = order[i], order[i + delta], right[i]
        use = ~(many[x] & many[y]) & (r + np.minimum(back[x], back[y]) >= size)
        x, y, r = x[use], y[use], r[use]
        left = extension(h, place[x], place[y], np.minimum(back[x], back[y]), -1)
        # strings start d before the anchor, size - r <= d <= left, and within both contexts
        lo = np.maximum(size - r, np.maximum(back[x] - n[x] + 1, back[y] - n[y] + 1))
        hi = np.minimum(left, np.minimum(back[x], back[y]))
        ok = lo <= hi
        total = np.append(0, np.cumsum(hit))
        for u, v, d0, d1 in zip(x[ok].tolist(), y[ok].tolist(), lo[ok].tolist(), hi[ok].tolist()):
            u0, u1, v0, v1 = (int(base[w] + back[w]) - d for w in (u, v) for d in (d1, d0))
            if total[u1 + 1] - total[u0] == d1 - d0 + 1 and total[v1 + 1] - total[v0] == d1 - d0 + 1:
                continue
            if ctx[u][back[u] - d1 : back[u] - d0 + size] == ctx[v][back[v] - d1 : back[v] - d0 + size]:
                hit[u0 : u1 + 1] = True
                hit[v0 : v1 + 1] = True
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    inner = base[1:-1]
    cut = np.zeros(len(hit) + 1, bool)
    cut[inner] = True
    a = np.flatnonzero((edge == 1) | (cut & np.append(hit, False) & np.append(False, hit)))
    z = np.flatnonzero((edge == -1) | (cut & np.append(hit, False) & np.append(False, hit)))
    owner = np.searchsorted(base, a, "right") - 1
    if len(a):
        keep = ~many[owner]
        a, z, owner = a[keep], z[keep], owner[keep]
    group = np.array(ah)[bucket]
    if len(a):
        none = pa.nulls(len(a), pa.list_(pa.int64()))
        yield pa.record_batch({"ah": pa.array(group[owner]), "cid": cid.take(pa.array(owner)), "a": pa.array(a - base[owner]), "z": pa.array(z - base[owner]), "at": none, "d": pa.nulls(len(a), pa.list_(pa.binary()))})
    dealt = np.repeat(np.asarray(salts)[bucket] > 1, n)
    if dealt.any():
        at = np.flatnonzero(dealt)
        own = np.searchsorted(base, at, "right") - 1
        s = begin[own] + at - base[own]
        text = K.span(h, s, s + size)
        take = ~hit[at]
        held = np.flatnonzero(hit[at])
        _, one = np.unique(text[held] ^ K.mix(bucket[own[held]].astype(np.uint64)), return_index=True)
        take[held[one]] = True
        at, own, s = at[take], own[take], s[take]
        raw = data.tobytes()
        d = pa.array([_digest(raw[j : j + size]) for j in s.tolist()], pa.binary())
        who, first = np.unique(own, return_index=True)  # one row a class
        cut = pa.array(np.append(first, len(own)).astype(np.int32))
        none = pa.nulls(len(who), pa.int64())
        yield pa.record_batch({
            "ah": pa.array(group[who]), "cid": cid.take(pa.array(who)), "a": none, "z": none, "at": pa.ListArray.from_arrays(cut, pa.array(at - base[own])), "d": pa.ListArray.from_arrays(cut, d),
        })


def repeated_strings(docs: DataFrame, size: int = 400, gram: int = 64, group: int = 1024) -> DataFrame:
    """doc_id and `runs`: (a, z) pairs; the strings that start at bytes a to z - 1 of the document repeat."""
    once = common.cut(common.repeated(docs.mapInArrow(_anchors(size, gram, True), "ah long, n long"), "ah"))
    found = docs.mapInArrow(_anchors(size, gram, False), "ah long, cid binary, doc_id long, lo long, n int, back int")
    found = common.store(found.join(once, "ah", "left_semi"))
    classes = found.groupBy("ah", "cid").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "lo")).alias("rep"), F.first("n").alias("n"), F.first("back").alias("back"))
    classes = common.store(classes.select("ah", "cid", "times", "rep.doc_id", "rep.lo", "n", "back"))
    open_ = classes.groupBy("ah").agg(F.count("*").alias("m"), F.min("times").alias("least")).where("m > 1 and least = 1")
    open_ = common.cut(open_.select("ah", F.ceil(F.col("m") / group).cast("int").alias("salts")))
    want = classes.join(open_, "ah").groupBy("doc_id").agg(F.collect_list(F.struct("ah", "cid", "lo", "n", "back", (F.col("times") > 1).alias("many"), "salts")).alias("want"))
    ctx = docs.join(want.hint("merge"), "doc_id").mapInArrow(_contexts(size), "ah long, cid binary, n int, back int, many boolean, salts int, ctx binary")
    ctx = ctx.groupBy("ah", "salts", F.pmod(F.xxhash64("cid"), F.col("salts")).alias("salt")).agg(F.collect_set(F.struct("cid", "n", "back", "many", "ctx")).alias("classes"))
    told = common.store(ctx.select("ah", "salts", "classes").mapInArrow(_compare(size), "ah long, cid binary, a long, z long, at array<long>, d array<binary>"))
    # the strings left over from one anchor are in few tasks; spread their classes before they become rows
    left = told.where("d is not null").repartition("cid").select("ah", "cid", F.explode(F.arrays_zip("at", "d")).alias("s"))
    left = left.select("ah", "cid", F.col("s.at").alias("a"), (F.col("s.at") + 1).alias("z"), "s.d")
    meet = common.cut(left.groupBy("ah", "d").agg(F.count("*").alias("n")).where("n > 1").select("ah", "d"))
    runs = told.where("d is null").select("ah", "cid", "a", "z").union(left.join(meet, ["ah", "d"], "left_semi").select("ah", "cid", "a", "z"))
    runs = runs.union(classes.where("times > 1").select("ah", "cid", F.lit(0).cast("long"), F.col("n").cast("long")))
    runs = common.store(runs.groupBy("ah", "cid").agg(F.collect_list(F.struct("a", "z")).alias("runs")))
    spread = found.select("ah", "cid", "doc_id", "lo").join(runs, ["ah", "cid"])
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("lo")).alias("a"), (r["z"] + F.col("lo")).alias("z")))
    return spread.groupBy("doc_id").agg(F.flatten(F.collect_list(moved)).alias("runs"))


def _apply(size: int):
    def run(batches):
        for batch, data, off in K.chunks(batches):
            runs, cols = batch.column("runs"), [[], [], [], []]
            valid = runs.is_valid().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                own = data[off[i] : off[i + 1]]
                gone = np.zeros(len(own) + 2, np.int64)
                if valid[i]:
                    v = runs[i].values
                    np.add.at(gone, v.field("a").to_numpy(), 1)
                    np.add.at(gone, v.field("z").to_numpy() - 1 + size, -1)
                drop = np.cumsum(gone)[: len(own)] > 0
                kept = own[~drop].tobytes()
                cols[0].append(int(drop.sum()))
                cols[1].append(int((np.diff(drop.astype(np.int8), prepend=0) == 1).sum()))
                cols[2].append(hashlib.sha256(kept).hexdigest())
                cols[3].append(kept)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(cols[0], pa.int64()), "n_spans": pa.array(cols[1], pa.int64()),
                "kept_sha256": pa.array(cols[2]), "kept": pa.array(cols[3], pa.binary()),
            })

    return run


def suffix_dedup(docs: DataFrame, size: int = 400, gram: int = 64, group: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (bytes).

    Every byte covered by a repeated string of `size` bytes goes, in every place, the first too. Null
    and empty texts have no bytes. Strings never cross documents. Repeated rows are copies of each
    other. A row without id keeps all its bytes, but counts for the others. Other columns are not read. An empty table gives an
    empty result. Strings are judged on the input.
    """
    docs = common.keyed(common.texts(docs, id_col, text_col))
    marks = repeated_strings(docs.select("doc_id", "text"), size, min(gram, size), group)
    joined = docs.join(marks, "doc_id", "left").select(F.col("own_id").alias("doc_id"), "text", F.when(F.col("own_id").isNotNull(), F.col("runs")).alias("runs"))
    return joined.mapInArrow(_apply(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
