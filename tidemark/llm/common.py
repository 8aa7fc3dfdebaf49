"""Shared helpers: reading tables, cutting lineage, ids of folds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Make sure a checkpoint folder is set: the session's own; one of this machine only where all tasks run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if given is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tidemark-cp-"))


def _release(spark: SparkSession) -> None:
    """Ask for a collection of unreachable DataFrames, so that Spark's cleaner drops the shuffle files of finished
    stages now and not at its next timer, and hand freed memory of the driver's Python back. Nothing depends on it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored once in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    _release(df.sparkSession)
    out = df.checkpoint(eager=True)
    _release(df.sparkSession)
    return out


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that others can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) stored once as (own_id, doc_id, text), doc_id now a key of the row that is never null."""
    return store(docs.select(F.col("doc_id").alias("own_id"), F.monotonically_increasing_id().alias("doc_id"), "text"))


def bounded_sample(rows: DataFrame, id_col: str, bound: int, total: int) -> DataFrame:
    """About `bound` rows, picked by a hash of the id; all rows where there are no more."""
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * bound / total))


def store(df: DataFrame) -> DataFrame:
    """As `cut`, but as a compressed table in the checkpoint folder; removed with that folder."""
    spark = df.sparkSession
    shared_dir(spark)
    _release(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _release(spark)
    return spark.read.parquet(path)


def repeated(keys: DataFrame, *cols: str, weight: str = "n") -> DataFrame:
    """Key tuples whose weights add up to two or more. Sums start in the map tasks, so a hot key is cheap."""
    return keys.groupBy(*cols).agg(F.sum(weight).alias("total")).where("total >= 2").select(*cols)


def commonest(df: DataFrame, bound: int, least: int = 1, n: str = "n") -> DataFrame:
    """Rows whose count is above a level that keeps at most `bound` of them; a histogram names the level."""
    df = df.where(F.col(n) >= least)
    level = F.floor(F.log2(n) * 8).cast("int")
    hist = sorted(((r.level, r.m) for r in df.groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect()), reverse=True)
    total, lowest = 0, None
    for lv, m in hist:
        if total + m > bound:
            break
        total, lowest = total + m, lv
    return df.where(level >= lowest) if lowest is not None else df.limit(0)
