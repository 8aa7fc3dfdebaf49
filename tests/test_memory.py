import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import discovery, memory
from tidemark.plans.queries import runs
from tidemark.sources import files


SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")


@needs_data
def test_synergies_need_more_than_two_runs(spark):
    got = memory.synergies(runs(spark, SF)).collect()
    assert got and all(r.n > 2 and r.a < r.b and r.mean_auc > 0.6 for r in got)


@needs_data
def test_report_has_a_line_a_model(spark):
    r = runs(spark, SF).cache()
    assert len(memory.report(r).splitlines()) == 1 + r.select("model").distinct().count()


def test_combinations_are_distinct():
    got = discovery.combinations_of(["open", "vol_a", "mom_b", "ret_c", "bb_d"])
    assert len(got) == len(set(got)) and all("open" not in c for c in got) and ("mom_b", "vol_a") in got


def test_epoch_units(spark):
    df = spark.createDataFrame([(1_700_000_000_000,), (1_700_000_000_000_123,)], "x long").select(files.epoch_ms(F.col("x")).alias("x"))
    assert [r.x for r in df.collect()] == [1_700_000_000_000, 1_700_000_000_000]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "k.csv").write_text("1700000000000000,1,2,0.5,1.5,10,a,b,c,d,e,f\n")
    k = files.read_klines(spark, f"file://{tmp_path}/k.csv")
    row = k.first()
    assert (row.open, row.high, row.low, row.close, row.volume) == (1.0, 2.0, 0.5, 1.5, 10.0)
    (tmp_path / "t.csv").write_text("5.0,2.0,10.0,1700000000000,x,y\n")
    assert files.read_ticks(spark, f"file://{tmp_path}/t.csv").first().price == 5.0
    files.save(k, f"file://{tmp_path}/out.parquet")
    assert files.load(spark, f"file://{tmp_path}/out.parquet", limit=1).count() == 1
    files.save(k, f"file://{tmp_path}/out.json", "json")
    assert files.newest(spark, f"file://{tmp_path}/out.json").count() == 1
    with pytest.raises(ValueError):
        files.load(spark, "x.pkl")
    with pytest.raises(FileNotFoundError):
        files.load(spark, f"file://{tmp_path}/none.parquet")
    metrics = spark.createDataFrame([("lda", 0.6), ("ridge", 0.7)], "model string, auc double")
    files.save_model_sets({"a": metrics, "b": metrics}, f"file://{tmp_path}/sets")
    assert [(r.label, r.model) for r in files.compare_model_sets(spark, f"file://{tmp_path}/sets").collect()] == [("a", "ridge"), ("a", "lda"), ("b", "ridge"), ("b", "lda")]
    assert files.stamped("/x/", "run").startswith("/x/run_2")
