"""Resampling, token output and the filter audit beside plain versions of themselves."""

import hashlib
import math
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty, prose
from tidemark.llm import id_coder, resample as resampling
from tidemark.llm.filter_audit import audit, filter_audit, standard_flags
from tidemark.llm.resample import resample
from tidemark.llm.token_output import read_tokens, token_output, write_tokens

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _features(text, buckets):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
    return w, [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _resampled(docs, target, buckets=10_000, share=5, least=20):
    made = [(i, *_features(t, buckets)) for i, t in docs]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, f in made:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, _features(x, buckets)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, w, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(able[: share * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("piece", [1 << 19, 7])
def test_resample(spark, monkeypatch, piece):
    """Also with pieces of seven words, so that n-grams and documents stand across pieces."""
    monkeypatch.setattr(resampling, "PIECE", piece)
    if piece == 7:  # workers don't see the patch: through the kernels alone
        words, off = b"One two2 three. four\x00five six seven EIGHT nine ten eleven one two2 three", None
        data = np.frombuffer(words + b" tail two2 three", np.uint8)
        off = np.array([0, len(words), len(data)])
        total, weighed = np.zeros(50, np.int64), 0
        for w, row, own in resampling.pieces(data, off, 3):
            for starts, which, bucket in resampling.tuples(w, row, 3, 50):
                np.add.at(total, bucket[which[starts < own]], 1)
        want = np.zeros(50, np.int64)
        for t in (words, b" tail two2 three"):
            np.add.at(want, _features(t.decode(), 50)[1], 1)
        assert (total == want).all()
        return
    docs = documents(spark).select("doc_id", "text", "lang", "n")
    more = [(100 + i, prose(i, 30 + i % 40)) for i in range(60)] + [(None, prose(8, 50)), (None, None), (300, "É" + prose(9, 25).upper() + "\x00a-b"), (301, "long " * 500_000)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    target = spark.createDataFrame([(prose(i, 20),) for i in range(10)] + [(None,), ("",)], "text string")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    got = resample(docs, target, share=40)
    assert sorted(map(tuple, got.collect()), key=repr) == _resampled(plain, [r.text for r in target.collect()], share=40)
    none = sorted(map(tuple, resample(docs.limit(30), target.limit(0)).collect()), key=repr)
    assert none == _resampled(plain[:30], [])
    assert resample(empty(spark), target).count() == 0


IDS = st.lists(st.one_of(st.integers(0, 99), st.integers(0, 3)), max_size=300)


@settings(max_examples=40, deadline=None)
@given(IDS)
def test_coder_round_trip(ids):
    assert id_coder.decode(id_coder.encode(np.array(ids, np.int64))).tolist() == ids


def test_coder():
    """Several groups of blocks, count updates, carries, odd vocabularies; damage is told; blocks stand alone."""
    rng = np.random.default_rng(5)
    assert id_coder.decode(id_coder.encode(np.array([2**32 - 1, 0, 7]))).tolist() == [2**32 - 1, 0, 7]
    for n, v in ((1, 1), (3000, 2), (20_000, 49_408), (id_coder.LANES * id_coder.LEAST + 5000, 300), (9000, 200_000)):
        x = np.minimum((rng.pareto(0.6, n) * 2).astype(np.int64), v - 1)
        assert (id_coder.decode(id_coder.encode(x)) == x).all()
    cycle = np.tile(rng.integers(0, 1000, 50), 400)
    made = id_coder.encode(cycle)
    assert len(made) < 0.25 * len(cycle)  # the models of order 1 and 2 foretell what repeats
    with pytest.raises(ValueError):
        id_coder.decode(made[:-4])
    for at in (40, 300, len(made) - 9):
        with pytest.raises(ValueError):
            id_coder.decode(made[:at] + bytes([made[at] ^ 1]) + made[at + 1 :])
    one = cycle[: 3 * 1024].reshape(3, 1024).T.copy()
    together = id_coder._encode(one, 1000)
    assert all((t == id_coder._encode(one[:, i : i + 1].copy(), 1000)[0]).all() for i, t in enumerate(together))


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_token_output(spark, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    more = [(None, "no id"), (None, None), (-4, "don't we'll 123 x́y  wide space\x0b\x1fA"), (200, "<|endoftext|> <|startoftext|>x"), (201, prose(3, 400_000, 5000)), (90, "日本語 text, ärger!!")]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("start", F.lit("x")).withColumn("ids", F.lit(1))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    each = {text: np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4") for _, text in rows}
    for options in ({}, {"words": False}):
        path = str(tmp_path / str(len(options)))
        write_tokens(docs, path, vocabulary, **options)
        got = sorted(read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is None, i))
        left, at = sorted(((i, each[text].tolist()) for i, text in rows), key=repr), 0
        for r in got:
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
            left.remove((r.doc_id, r.ids))
            at += r.n_tokens
        assert not left
    assert token_output(docs, vocabulary).count() == len(rows)
    assert token_output(empty(spark), vocabulary).count() == 0
    broken = spark.read.parquet(path).withColumn("ids", F.expr("overlay(ids placing X'FF' from 90)"))
    broken.write.parquet(str(tmp_path / "broken"))
    with pytest.raises(Exception, match="checksum|cut off|add up"):
        read_tokens(spark, str(tmp_path / "broken")).collect()


def test_words_straight_to_the_merges(vocabulary):
    """Each distinct word asks the library for its merges alone, once; the ids are those of the whole texts."""
    from tokenizers import Tokenizer
    from tidemark.llm import token_output

    t = Tokenizer.from_file(vocabulary)
    marks = ["Straße", "ÀÉÎ", "ÿ×÷x", "e\u0301t\u00e9", "ΣΑΣ", "İx", "a<|endoftext|>b", "it's", "12a3", "--x--", "\x7fq", "a\u00a0b", "ªº", "\u00adx", "ﬁ", "don’t", "£5", "x" * 300, "日本", "ĦeĿ"]
    rng = np.random.default_rng(3)
    alphabet = list("aBzé'<ÄßÞ0 9-|>ñ.,\t")
    for text in [" ".join(marks), *marks, prose(4, 300), *("".join(rng.choice(alphabet, 60)) for _ in range(300))]:
        batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([text])})
        (_, ids, n), = token_output.encoded(iter([batch]), vocabulary, 2, True)
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids + [2], text
    store = token_output.WordIds(t)
    asked = []
    store.tokenizer = type("None", (), {"encode_batch_fast": lambda self, w, **k: asked.extend(w)})()
    assert store.plain and len(store.encode(["Haus,", "über", "x1", "Haus"])) == 4 and not asked


def test_pieces_are_kept_not_words(vocabulary, monkeypatch):
    """Words that differ in case and signs share their pieces: the library is asked once for each, in the texts of all batches."""
    from tokenizers import Tokenizer
    from tidemark.llm import token_output

    store, asked = token_output.WordIds(Tokenizer.from_file(vocabulary)), []
    model = store.model
    store.model = type("Spy", (), {"tokenize": lambda self, w: asked.append(w) or model.tokenize(w)})()
    monkeypatch.setattr(token_output, "_store", lambda path: store)
    texts = ["Thonin, thonin. (THONIN) thonin-x", "thonin,thonin Élan7", "\u00e9lan 7 it's"]
    for text in texts:
        (_, ids, _), = token_output.encoded(iter([pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([text])})]), vocabulary, 2, True)
        assert ids.tolist() == store.tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert len(asked) == len(set(asked)) == 9  # thonin , . ( ) - x 7 and the letters of élan


def _fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((i, part or "", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i)))
    return out


def _audited(fails, good, toxic):
    """Filters applied one after the other to the documents of each part and order."""
    out = {}
    for part in {p for _, p, _ in fails}:
        mine = [(i, dict(zip("ABCDE", f))) for i, p, f in fails if p == part]
        gone = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            now, before = mine, []
            for step, f in enumerate(order, 1):
                bad = [i for i, x in now if x[f]]
                now = [(i, x) for i, x in now if not x[f]]
                gone[f] += len(bad)
                redundant = sum(x[f] and any(x[b] for b in before) for _, x in mine)
                out[part, order, step] = [len(now), len(bad), redundant, sum(x[f] and sum(x.values()) == 1 for _, x in mine), sum(i in good for i in bad), sum(i in toxic for i in bad), f]
                before.append(f)
        for (p, *_), v in out.items():
            if p == part:
                v[6] = gone[v[6]]
    return {(*k, *v) for k, v in out.items()}


def test_filter_audit(spark):
    texts = [prose(1, 250), prose(1, 250), "a # b", "", None, "ABC DEF", "x " * 300, "x " * 300 + "| Z", "Ä" * 40 + "A", prose(2, 220, 50), prose(3, 210).upper(), prose(1, 250)]
    rows = [(i, t, (None, "", "en")[i % 3] if i != 5 else "de") for i, t in enumerate(texts)] + [(3, "", "en"), (3, "", "en"), (None, "", "en"), (None, prose(1, 250), None), (40, prose(4, 90_000, 60_000), "en")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, part int, A boolean")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 0, None), (2, None, 1), (3, 1, 1), (99, 1, 1), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(repr, ((r.doc_id, r.part, (r.A, r.B, r.C, r.D, r.E)) for r in standard_flags(docs).collect()))) == sorted(map(repr, _fails(rows)))
    got = filter_audit(docs, labels)
    cols = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    made = [tuple(r[c] for c in cols) for r in got.collect()]
    assert len(made) == 3 * 600 and set(made) == _audited(_fails(rows), {0, 1, 3}, {1, 2, 3, 7})
    assert all(r[1][r[2] - 1] == f for r, f in zip(made, [r["filter"] for r in got.collect()]))
    assert filter_audit(empty(spark), labels).count() == 0 and filter_audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_two_filters(spark):
    counts = spark.createDataFrame([("p", True, False, 5, 1, 0), ("p", True, True, 2, 0, 1), ("p", False, False, 3, 0, 0)], "part string, x boolean, y boolean, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit(counts, ["x", "y"]).collect()}
    assert got == {("xy", 1): (3, 7, 0, 5, 1, 1, 12), ("xy", 2): (3, 0, 2, 0, 0, 0, 2), ("yx", 1): (8, 2, 0, 0, 0, 1, 2), ("yx", 2): (3, 5, 2, 5, 1, 0, 12)}
