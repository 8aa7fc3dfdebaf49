"""Runs and knowledge that outlive their session."""

import pytest
from pyspark.sql import functions as F

from tests.test_research import table
from tidemark.operators import agent, archive


def test_runs_and_knowledge(spark, tmp_path):
    runs = spark.createDataFrame([(i, label, "BULL", "lda", 0.5 + i / 100, 0.5, 0.5, 0.1, 1.0, 0.5, 9, ["a"]) for i, label in enumerate(["x_label", "7", "x_label"])], agent.RUN_SCHEMA)
    path = f"file://{tmp_path}/runs"
    with pytest.raises(FileNotFoundError):
        archive.load_runs(spark, path)
    first = archive.save_runs(runs.where("run_id < 2"), path)
    assert archive.save_runs(runs.where("run_id = 2"), path) != first
    got = archive.load_runs(spark, path)
    assert sorted((r.run_id, r.label) for r in got.collect()) == [(0, "x_label"), (1, "7"), (2, "x_label")]
    one = archive.load_runs(spark, path, ["7"])
    assert [r.run_id for r in one.collect()] == [1] and "PartitionFilters: [isnotnull(label" in one._jdf.queryExecution().executedPlan().toString()
    session = archive.resume(spark, path, regime="CRISIS")
    assert session.runs.count() == 3 and archive.added(session, path).count() == 0
    session.runs = session.runs.union(runs.limit(1).withColumn("run_id", F.lit(3).cast("long")))
    assert [r.run_id for r in archive.added(session, path).collect()] == [3]
    assert archive.resume(spark, f"file://{tmp_path}/none").runs is None
    known = spark.createDataFrame([("e", "f", "m", 0.4, 1.0), ("e", "g", "m", 0.2, 2.0), ("h", "f", "m", 0.3, 3.0)], "event string, feature string, mechanism string, strength double, total double")
    path = f"file://{tmp_path}/known"
    archive.save_knowledge(known, path)
    archive.save_knowledge(known.where("feature = 'f' and event = 'e'").withColumn("total", F.lit(9.0)), path)
    assert sorted((r.event, r.feature, r.total) for r in archive.load_knowledge(spark, path).collect()) == [("e", "f", 9.0), ("e", "g", 2.0), ("h", "f", 3.0)]
    assert archive.load_knowledge(spark, path, ["h"]).count() == 1


def test_research_pipeline(spark, tmp_path):
    df, *_ = table(spark, 160)
    asked = []

    def get(label):
        asked.append(label)
        return df, ["a", "b", "c"]

    cfg = {"models": ("lda",), "folds": 2, "most_features": 3}
    path = f"file://{tmp_path}/research"
    out = archive.research_pipeline(spark, ["one", "two"], get, path, cfg | {"quick": True})
    assert out["done"] == ["one", "two"] and not out["skipped"] and out["config"]["genetic"] is False
    assert {(r.label, r["rank"], r.model) for r in out["results"].collect()} == {("one", 1, "lda"), ("two", 1, "lda")}
    again = archive.research_pipeline(spark, ["one", "two", "three"], get, path, cfg | {"seconds": -1.0})
    assert asked == ["one", "two"] and again["skipped"] == ["three"] and again["results"].count() == 2
    more = archive.research_pipeline(spark, ["four"], get, path, cfg)
    assert {r.feature for r in more["chosen"].collect()} >= {"a"} and more["results"].first().auc > 0.8
