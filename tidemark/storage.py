"""Tables written in the shared checkpoint folder, to compute once what several passes read and to plan by real sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in the session's checkpoint folder; that is one of this machine only where all tasks run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if given is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tidemark-cp-"))
    return f"{sc.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """The same rows as a table in the checkpoint folder."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
