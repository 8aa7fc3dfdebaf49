"""Readers and writers of ticks, klines and bars."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The column order of headerless files.
TICK_FIELDS = "price double, qty double, value double, time bigint, c1 string, c2 string"
KLINE_FIELDS = "time bigint, open double, high double, low double, close double, volume double, " + ", ".join(f"x{i} string" for i in range(6))


def epoch_ms(c: Column) -> Column:
    """Milliseconds from milliseconds or microseconds: values from 10**15 on are microseconds."""
    return F.when(c >= F.lit(10**15), F.floor(c / 1000)).otherwise(c).cast("bigint")


def read_ticks(spark: SparkSession, path: str, symbol: str = "SYM") -> DataFrame:
    """Headerless tick files (a glob reads all that match)."""
    raw = spark.read.schema(TICK_FIELDS).csv(path)
    return raw.select(F.lit(symbol).alias("symbol"), F.timestamp_millis(epoch_ms(F.col("time"))).alias("ts"), "price", "qty", "value")


def read_klines(spark: SparkSession, path: str, symbol: str = "SYM") -> DataFrame:
    """Headerless 12-column candle files; time is the opening time."""
    raw = spark.read.schema(KLINE_FIELDS).csv(path)
    return raw.select(F.lit(symbol).alias("symbol"), F.timestamp_millis(epoch_ms(F.col("time"))).alias("ts"), "open", "high", "low", "close", "volume")


def load(spark: SparkSession, path: str, schema: str | None = None, limit: int | None = None, order: str = "ts") -> DataFrame:
    """A table by its suffix: parquet, csv (with header), json or xlsx (the first sheet, read in parts).

    `limit` keeps the first rows by `order` (a top-k: no full sort). Other suffixes are a ValueError (the binary xls too),
    pickles too, as reading one runs its code; a path that isn't there is a FileNotFoundError.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("parquet", "csv", "json", "xlsx"):
        raise ValueError(f"unsupported file type: {path}")
    try:
        if kind == "parquet":
            df = spark.read.parquet(path)
        elif kind == "csv":
            df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
        elif kind == "json":
            df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
        else:
            from tidemark.sources.workbooks import register

            register(spark)
            reader = spark.read.format("workbook")
            df = (reader.schema(schema) if schema else reader).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "FileNotFoundError" in str(e):
            raise FileNotFoundError(path) from e
        raise
    return df if limit is None else df.orderBy(order).limit(limit)


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def stamped(path: str, stem: str) -> str:
    """A name under path that carries the time, for results that must not replace each other."""
    return f"{path.rstrip('/')}/{stem}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}"


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest JSON file under path; only that file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    last = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if last is None:
        raise FileNotFoundError(path)
    return spark.read.json(last.path)


def save_model_sets(sets: dict[str, DataFrame], path: str) -> None:
    """One JSON table of metrics for each label."""
    for label, metrics in sets.items():
        save(metrics.withColumn("label", F.lit(label)), f"{path.rstrip('/')}/label={label}", "json")


def compare_model_sets(spark: SparkSession, path: str) -> DataFrame:
    """The saved sets' metrics, the best model of each label first."""
    return spark.read.json(f"{path.rstrip('/')}/*").orderBy("label", F.desc("auc"), "model")
