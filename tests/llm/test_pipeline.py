import os

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import prose

SF = "/root/testdata/sf0.001"
top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(f"{top}/corpus_pipeline.py"), reason="needs the small tables and the pipeline")


def _kept(texts: dict) -> set:
    """Ids that stay when near copies go: five-word shingles, similarity 0.8, the smallest id of a component."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root, order = {i: i for i in sets}, sorted(sets)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = {x: lo if y == hi else y for x, y in root.items()}
    return {i for i, r in root.items() if i == r}


def test_pipeline(spark):
    """Each stage keeps what its rule, in plain Python, keeps."""
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "minhash_dedup", "decontamination", "secret_scan", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in c.STAGES[:-1]:
        before = {r.doc_id: r.text or "" for r in now.collect()}
        rows = stage(spark, now, SF).collect()
        assert rows[0].__fields__ == docs.columns
        now, ids = spark.createDataFrame(rows, docs.schema), {r.doc_id for r in rows}
        if name == "toxicity":
            assert ids < set(before)
        if name == "minhash_dedup":
            assert ids == _kept(before)
        if name == "decontamination":
            items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not [i for i in ids for x in items if x in before[i].lower()]
        if name == "secret_scan":
            assert ids == set(before)
    assert not any("AKIA" in (r.text or "") for r in now.where("text rlike 'AKIA[A-Z0-9]{16}'").collect())
    last = c.STAGES[-1][1](spark, now, SF)
    assert 0 < last.count() < now.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, predicted int, kept boolean, topic string, found string, probability double"


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, stage):
    """Nulls in any column, repeated rows and ids, empty texts, extra and clashing columns, an empty table."""
    import corpus_pipeline as c

    rows = [(1, prose(1, 40), "en", "a"), (1, prose(1, 40), "en", "a"), (2, "password=hunter22 " + prose(2, 30), None, None), (2, "token=abcdef99", "en", "a"), (3, None, None, None), (4, "", "en", "a"), (None, prose(4, 20), "en", "b"), (None, None, None, None)]
    docs = spark.createDataFrame([(i, t, la, s, len(t or ""), 1, False, "x", "y", 0.5) for i, t, la, s in rows], ODD)
    name, run = c.STAGES[stage]
    done = run(spark, docs, SF)
    out = done.collect()
    if name == "mixing":
        assert set(docs.columns) <= set(done.columns) and {r.doc_id for r in out} <= {1, 2, None}
    else:
        assert len(out) == len(rows) and out[0].__fields__ == docs.columns
    if name == "secret_scan":
        texts = sorted(r.text for r in out if r.doc_id == 2)
        assert texts[0] == "[REDACTED]" and texts[1].startswith("[REDACTED] w")
    assert run(spark, docs.where(F.lit(False)), SF).count() == 0
