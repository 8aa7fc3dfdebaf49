import collections
import hashlib
import re

import numpy as np

from tests.llm.fixtures import documents, empty, prose
from tidemark.llm.components import components
from tidemark.llm.embedding_dedup import embedding_dedup
from tidemark.llm.minhash_dedup import minhash_dedup
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.suffix_dedup import suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def test_substring_dedup(spark):
    docs = documents(spark)
    rows = [(r.doc_id, WORD.findall((r.text or "").encode())) for r in docs.collect()]
    n = 35
    times = collections.Counter(tuple(w[j : j + n]) for _, w in rows for j in range(len(w) - n + 1))
    want = collections.Counter()
    for i, w in rows:
        keep = [True] * len(w)
        for j in range(len(w) - n + 1):
            if times[tuple(w[j : j + n])] > 1:
                keep[j : j + n] = [False] * n
        want[i, len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, k in zip(w, keep) if k)).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in substring_dedup(docs, n).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
    assert substring_dedup(empty(spark), n).count() == 0


def _bytes_removed(rows, n):
    times = collections.Counter(b[j : j + n] for _, b in rows for j in range(len(b) - n + 1))
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if times[b[j : j + n]] > 1:
                gone[j : j + n] = b"\1" * n
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        yield i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def test_suffix_dedup(spark):
    docs = documents(spark)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for n, gram, group in ((120, 32, 1024), (60, 16, 2)):
        got = collections.Counter(tuple(r) for r in suffix_dedup(docs, n, gram, group).drop("kept").collect())
        assert got == collections.Counter(_bytes_removed(rows, n))
    assert suffix_dedup(empty(spark)).count() == 0


def _roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_minhash_dedup(spark):
    docs = documents(spark)
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r.text or "").encode().lower())
        sets[r.doc_id] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = _roots(sets, links)
    for small, block in ((64, 512), (1, 2)):
        got = minhash_dedup(docs, 3, "0.85", small=small, block=block).collect()
        assert len(got) == docs.count()
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert minhash_dedup(empty(spark)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(20)] + [(100, 101), (5, 5), (None, 3), (101, 100)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 8))
    for i in range(40, 70):
        x[i] = x[0] + 0.05 * rng.standard_normal(8)
    x[70] = x[1]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(200, None, "c"), (201, [0.0] * 8, "c"), (202, [float("nan")] * 8, "c"), (203, [None] * 8, "c"), (204, [], "c"), (205, [float("inf")] * 8, "c")]
    got = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string"), k=4, tables=4, block=16).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    root = _roots(range(120), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(link)))])
    for i in range(120):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), root[i], root[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(200, 206))
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def _embedded(spark, x, **options):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    return got, link


def test_embedding_dedup_saturated(spark):
    """Two tight groups larger than k, linked with each other: each fills its own lists."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 240, 24):
        side = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        near = 0.96 * x[i] + np.sqrt(1 - 0.96**2) * side / np.linalg.norm(side)
        x[i : i + 12] = x[i] + 0.002 * rng.standard_normal((12, 16))
        x[i + 12 : i + 24] = near + 0.002 * rng.standard_normal((12, 16))
    got, link = _embedded(spark, x, audited=1)
    assert link[0, :24].sum() == 23
    root = _roots(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(link)))])
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(link[i].sum(), root[i]) for i in range(len(x))]


def test_embedding_dedup_recall(spark):
    """A hot group with most of the links must not hide the recall of the pairs; few vectors are audited."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((5000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:300] = x[0] + 0.002 * rng.standard_normal((300, 16))
    for i in range(1000, 5000, 2):
        side = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        x[i + 1] = 0.955 * x[i] + np.sqrt(1 - 0.955**2) * side / np.linalg.norm(side)
    got, link = _embedded(spark, x, audited=20, tables=1, rounds=0)
    found = [np.mean([min(got[i].n_links, link[i].sum()) / link[i].sum() for i in part if link[i].any()]) for part in (range(300), range(1000, 5000))]
    assert found[0] == 1 and found[1] >= 0.98
    assert all(got[i].n_links <= link[i].sum() for i in range(len(x)))
    assert {r.audit_recall >= 0.99 for r in got.values()} == {True}


def test_null_id_counts_for_others(spark):
    """A null-id row and document 9 share one passage in different contexts."""
    shared = prose(1, 80)
    docs = spark.createDataFrame([(None, prose(21, 60) + " " + shared), (9, prose(22, 60) + " " + shared + " " + prose(23, 30)), (10, prose(24, 60))], "doc_id long, text string")
    n_bytes, n_words = ({r.doc_id: r.n_removed for r in out.collect()} for out in (suffix_dedup(docs, 200, 32), substring_dedup(docs)))
    assert n_bytes[9] >= len(shared) and n_words[9] >= 80
    assert n_bytes[None] == n_words[None] == n_bytes[10] == n_words[10] == 0
