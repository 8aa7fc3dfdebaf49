"""What sessions leave behind: runs by label and knowledge by event, kept as partitioned tables, and the whole research of many
labels as one call that writes as it goes and can be taken up again."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import agent, models, scoring
from tidemark.storage import store

DEFAULTS = {"most_features": 15, "genetic": True, "models": ("logistic", "lda", "ridge"), "folds": 3, "quick": False, "seconds": 3600.0}


def _append(df: DataFrame, path: str, by: str) -> str:
    """Add rows, stamped with their session and time; a partition's files are those of its value alone."""
    session = uuid.uuid4().hex
    df.withColumn("session", F.lit(session)).withColumn("saved_at", F.current_timestamp()).write.mode("append").partitionBy(by).parquet(path)
    return session


def _read(spark: SparkSession, path: str, by: str, values: Iterable[str] | None) -> DataFrame:
    """All rows, or those of some values, whose folders alone are read. Names stay strings, whatever they look like."""
    inferred = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", inferred)
    return df if values is None else df.where(F.col(by).isin(*values))


def _latest(df: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: the last saved, of the last session by name if they were saved at once."""
    w = Window.partitionBy(*key).orderBy(F.desc("saved_at"), F.desc("session"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def save_runs(runs: DataFrame, path: str) -> str:
    """Add a table of runs, by label; returns the session's name."""
    return _append(runs, path, "label")


def load_runs(spark: SparkSession, path: str, labels: Iterable[str] | None = None) -> DataFrame:
    """The saved runs of all or some labels, of all sessions, with session and saved_at."""
    return _read(spark, path, "label", labels)


def save_knowledge(known: DataFrame, path: str) -> str:
    """Add relationships (event, feature, ...), by event; returns the session's name."""
    return _append(known, path, "event")


def load_knowledge(spark: SparkSession, path: str, events: Iterable[str] | None = None) -> DataFrame:
    """What is known of all or some events: the last saved relationship of each event and feature."""
    known = _latest(_read(spark, path, "event", events), ["event", "feature"])
    return known.drop("session", "saved_at")


def resume(spark: SparkSession, path: str, **options) -> agent.Session:
    """A session that knows the saved runs; its own runs are numbered after theirs. Save what it adds with `save_runs(added(...))`."""
    session = agent.Session(spark, **options)
    try:
        session.runs = load_runs(spark, path).drop("session", "saved_at").select(*agent.RUN_COLUMNS)
    except FileNotFoundError:
        pass
    return session


def added(session: agent.Session, path: str) -> DataFrame | None:
    """The session's runs that aren't among the saved ones."""
    if session.runs is None:
        return None
    try:
        return session.runs.join(load_runs(session.spark, path).select("run_id").distinct(), "run_id", "left_anti").select(*session.runs.columns)
    except FileNotFoundError:
        return session.runs


def research_pipeline(spark: SparkSession, labels: Iterable[str], get: Callable[[str], tuple[DataFrame, list[str]]], path: str, config: dict[str, Any] | None = None) -> dict[str, Any]:
    """Research of every label (get gives its frame with y and ret, and its columns), saved under `path` label by label.

    config: most_features, genetic (choose columns by the genetic search over shared moments), models, folds, quick (ten features, no
    search) and seconds; after nine tenths of these no new label is begun. Labels that are already saved are taken from there. Returns
    results (label, rank, model, metrics and economics), chosen (label, feature), done, skipped and the seconds used.
    """
    cfg = DEFAULTS | (config or {})
    if cfg["quick"]:
        cfg |= {"most_features": min(10, cfg["most_features"]), "genetic": False}
    start, skipped, base = time.monotonic(), [], path.rstrip("/")
    labels = list(labels)
    try:
        saved = {r.label for r in load_runs(spark, f"{base}/results").select("label").distinct().collect()}
    except FileNotFoundError:
        saved = set()
    for label in labels:
        if label in saved:
            continue
        if time.monotonic() - start > 0.9 * cfg["seconds"]:
            skipped.append(label)
            continue
        df, columns = get(label)
        df = store(df.select("symbol", "ts", *columns, "y", "ret"))
        out = agent.research(df, columns, cfg["most_features"], cfg["models"], cfg["folds"])
        chosen, ranked = out["features"], out["models"]
        if cfg["genetic"] and len(chosen) > 2:
            filled = store(agent.prepare(df, columns)[0])
            chosen = models.genetic_selection(filled, chosen, "lda", cfg["folds"], population=20, generations=10, least=min(3, len(chosen)))
            ranked = scoring.rank_models(models.cross_validate(filled, chosen, list(cfg["models"]), cfg["folds"]))
        place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "model"))
        rows = ranked.join(out["economics"], "model", "left").withColumn("label", F.lit(label)).withColumn("rank", place)
        _append(spark.createDataFrame([(label, c) for c in chosen], "label string, feature string"), f"{base}/chosen", "label")
        _append(rows, f"{base}/results", "label")  # last: a label with results is whole
        saved.add(label)
    done = [x for x in labels if x in saved]
    empty = not done
    results = None if empty else _latest(load_runs(spark, f"{base}/results", done), ["label", "model"]).drop("session", "saved_at")
    chosen = None if empty else _latest(load_runs(spark, f"{base}/chosen", done), ["label", "feature"]).drop("session", "saved_at")
    return {"config": cfg, "results": results, "chosen": chosen, "done": done, "skipped": skipped, "seconds": time.monotonic() - start}
