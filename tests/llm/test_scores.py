import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty, prose
from tidemark.llm.lm_score import lm_score
from tidemark.llm.quality import quality
from tidemark.llm.toxicity import toxicity

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("hot", [262_144, 50])
def test_lm_score(spark, hot):
    docs = documents(spark)
    rows = [(r.doc_id, WORD.findall((r.text or "").encode().lower()) + [0]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(t for i, w in rows if not held(i) for t in w)
    n, v = sum(c.values()), len(c)
    got = lm_score(docs, hot=hot).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, w in rows:
        r = by[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[t] > 0 for t in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w))
        assert r.score <= 0
    assert lm_score(empty(spark)).count() == 0


def _model(texts, arcs, mu):
    """The same model from plain counters: a function (u, v, w) -> probability, None for the start."""
    c1, c2, c3, h1 = (collections.Counter() for _ in range(4))
    for t in texts:
        t = [None, *t]
        for i in range(1, len(t)):
            c1[t[i]] += 1
            h1[t[i - 1]] += 1
            c2[t[i - 1], t[i]] += 1
            if i > 1:
                c3[t[i - 2], t[i - 1], t[i]] += 1
    total = sum(c1.values())
    least = max(1, math.ceil(total / arcs))
    kept = {g: n for g, n in c3.items() if n >= least}
    mass = collections.Counter()
    for (u, v, _), n in kept.items():
        mass[u, v] += n

    def p(u, v, w, trigram):
        p1 = (c1[w] + 0.1) / (total + 0.1 * (len(c1) + 1))
        p2 = (c2[v, w] + mu * p1) / (h1[v] + mu)
        n = c2[u, v]
        if not trigram or n < least:
            return p2
        return (kept.get((u, v, w), 0) + (mu + n - mass[u, v]) * p2) / (n + mu)

    return p, c1


@pytest.mark.parametrize(("arcs", "hot", "mu"), [(200_000, 10_000, 1000.0), (300, 40, 7.0), (40, 1, 50.0)])
def test_lm_score_against_counters(spark, arcs, hot, mu):
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(None, "two words"), (20, prose(5, 120)), (20, prose(5, 120)), (30, prose(8, 60))], "doc_id long, text string"))
    rows = [(r.doc_id, WORD.findall((r.text or "").encode().lower()) + [0]) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    p, c1 = _model([w for i, w in rows if not held(i)], arcs, mu)
    vocabulary = [*c1, b"never seen"]
    for u, v in [(None, b"two"), (b"two", b"words"), (rows[0][1][3], rows[0][1][4])]:
        assert sum(p(u, v, w, True) for w in vocabulary) == pytest.approx(1)

    def score(t):
        t = [None, *t]
        return sum(math.log10(p(t[i - 2] if i > 1 else None, t[i - 1], t[i], i > 1)) for i in range(1, len(t)))

    want = sorted((-1 if i is None else i, round(score(w), 6)) for i, w in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in lm_score(docs, arcs=arcs, hot=hot, mu=mu).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-5)


def test_lm_score_complete(spark):
    """Over a million training tokens, so that one sighting is less than a millionth of them: rare trigrams count all the same."""
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(None, "two words"), (20, prose(5, 120)), (20, prose(5, 120)), (31, "x " * 1_100_000)], "doc_id long, text string"))
    rows = [(r.doc_id, WORD.findall((r.text or "").encode().lower()) + [0]) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    assert not held(31)
    p, c1 = _model([w for i, w in rows if not held(i)], 10**9, 100.0)
    for u, v in [(None, b"two"), (rows[0][1][3], rows[0][1][4])]:
        assert sum(p(u, v, w, True) for w in [*c1, b"never seen"]) == pytest.approx(1)
    want = []
    for i, w in rows:
        t = [None, *w]
        want.append((-1 if i is None else i, round(sum(math.log10(p(t[j - 2] if j > 1 else None, t[j - 1], t[j], j > 1)) for j in range(1, len(t))), 6)))
    got = [(-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in lm_score(docs).collect()]
    assert [i for i, _ in sorted(got)] == [i for i, _ in sorted(want)]
    assert [x for _, x in sorted(got)] == pytest.approx([x for _, x in sorted(want)], abs=1e-5)


def _labelled(spark, marked):
    rows = [(i, prose(i + 500, 60, 150) + (marked if i % 3 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9002, "")], "doc_id long, text string").selectExpr("*", "'z' as y", "1 as shard")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0 if i % 3 else 1, "q") for i, _ in rows] + [(None, 1, 1, "q"), (9001, None, None, "q")], "doc_id long, quality int, toxic int, text string")
    return docs, labels


def _check(out, labels, column, of, held_is):
    rows = out.collect()
    assert len(rows) == 603 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == held_is) for r in rows)
    y = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.held_out and y.get(r.doc_id) is not None]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.9


def test_toxicity(spark):
    docs, labels = _labelled(spark, " awful rotten")
    _check(toxicity(docs, labels), labels, "toxic", 5, 0)
    assert toxicity(empty(spark), labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in toxicity(docs, none).collect()} == {0.0}


def test_quality(spark):
    docs, labels = _labelled(spark, " BUY!! NOW!! BUY!! NOW!!")
    _check(quality(docs, labels), labels, "quality", 4, 2)
    assert quality(empty(spark), labels).count() == 0
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_fixed_wording(spark):
    """Toxic texts whose only evidence is one expression in one wording: it opens the text, as another one opens ordinary texts."""
    docs, labels = _labelled(spark, " zug kran vole")
    docs = docs.withColumn("text", F.regexp_replace("text", "^(.*) (zug kran vole)$", "$2 $1"))
    docs = docs.withColumn("text", F.regexp_replace("text", "^(w.*)$", "mel tor wis $1"))
    y = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    held = [r for r in toxicity(docs, labels).collect() if r.held_out and r.doc_id in y]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.9


def _rest(counts):
    n1, n2 = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
    return n1 / (n1 + 2 * n2) if n1 else 0.5


@pytest.mark.parametrize("least", [1, 2])
def test_toxicity_models_against_brute_force(spark, least):
    """Both ratios of every word, from counters in plain Python."""
    from tidemark.llm import kernels as K
    from tidemark.llm import toxicity as T

    texts = [(prose(i, 40, 30) + (" awful thing" if i % 3 == 0 else " fine day"), int(i % 3 == 0)) for i in range(40)]
    pair = collections.Counter()
    for t, y in texts:
        w = t.split()
        pair.update((a, b, y) for a, b in zip(["<s>", *w[:-1]], w))
    bigrams, words = {p[:2] for p in pair}, {p[1] for p in pair}
    cont = collections.Counter((b, y) for _, b, y in pair)
    both = {x: sum(pair[(*x, y)] > 0 for y in (0, 1)) for x in bigrams}
    held = {b: sum(cont[b, y] > 0 for y in (0, 1)) for b in words}
    d1, d2 = ([_rest([c[k, y] if isinstance(k, str) else c[(*k, y)] for k in keys]) for y in (0, 1)] for c, keys in ((cont, words), (pair, bigrams)))
    ds1, ds2, total = _rest(held.values()), _rest(both.values()), sum(held.values())
    even = (1 - sum(max(h - ds1, 0) for h in held.values()) / total) / (len(words) + 1)

    def p_word(b, y):
        n = sum(cont[x, y] for x in words)
        left = 1 - sum(max(cont[x, y] - d1[y], 0) for x in words) / n
        return max(cont[b, y] - d1[y], 0) / n + left * (max(held.get(b, 0) - ds1, 0) / total + even)

    def p_pair(a, b, y):
        kept = [x for x in bigrams if x[0] == a and sum(pair[(*x, k)] for k in (0, 1)) >= least]
        if not kept:
            return p_word(b, y)
        n, ns = sum(pair[(*x, y)] for x in bigrams if x[0] == a), sum(both[x] for x in bigrams if x[0] == a)
        lam = 1 - sum(max(pair[(*x, y)] - d2[y], 0) for x in kept) / max(n, 1)
        low = 1 - sum(max(both[x] - ds2, 0) for x in kept) / ns
        own = (max(pair[a, b, y] - d2[y], 0) / max(n, 1), max(both[a, b] - ds2, 0) / ns) if (a, b) in kept else (0.0, 0.0)
        return own[0] + lam * (own[1] + low * p_word(b, y))

    model = T.fit(spark.createDataFrame(texts, "text string, y int"), least)
    for t in (texts[0][0], texts[1][0] + " unheard words here"):
        data = np.frombuffer(t.encode(), np.uint8)
        h, first = T.tokens(data, np.array([0, len(data)]))
        got = model.ratios(h, T.before(h, first))
        w = t.split()
        for i, (a, b) in enumerate(zip(["<s>", *w[:-1]], w)):
            want = (math.log(p_word(b, 1) / p_word(b, 0)), math.log(p_pair(a, b, 1) / p_pair(a, b, 0)))
            assert got[i] == pytest.approx(want, abs=1e-9)
    for y in (0, 1):  # the bigram models sum to one
        assert sum(p_pair("<s>", b, y) for b in words) + p_pair("<s>", "?", y) == pytest.approx(1)
    assert K.find(model.word, h[-1:])[0] == -1
