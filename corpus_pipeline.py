"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to
the shared checkpoint folder and reads it back as the next stage's documents.

All stages: an empty table gives an empty result; null and empty texts are documents like any other
(never rejected by the first four stages, never sampled by the last, which mixes tokens). Repeated rows
share their decision. Toxicity and benchmark passages are decided by text, whatever the id; near-duplicates by id, so
that rows without one stay there, and rows of one id go together. Secrets are replaced in each text by itself. Other columns of the documents are carried along. Texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.minhash_dedup import minhash_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.secret_scan import redact, secret_scan
from tidemark.llm.toxicity import toxicity


def without_texts(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The documents whose text isn't one of those with the digests of `bad`, whatever their ids, with all their columns."""
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    bad = bad.select(F.col("text_sha256").alias("_digest")).distinct()
    return docs.join(bad, digest == F.col("_digest"), "left_anti").select(*docs.columns)


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The documents whose ids aren't in `bad`, with all their columns."""
    return docs.join(bad.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject."""
    return without_texts(docs, toxicity(docs, common.table(spark, sf_dir, "labels")).where("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return without(docs, minhash_dedup(docs).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_texts(docs, decontaminate(docs, common.table(spark, sf_dir, "benchmark")).where("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced in the text and its length in n_chars."""
    found = secret_scan(docs).where("n_live > 0").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text"), F.col("found").alias("_found"))
    found = found.dropDuplicates(["_id", "_text"])
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.sha2("text", 256) == F.col("_text"))
    text = redact(F.col("text"), F.col("_found"))
    new = {"text": text, "n_chars": F.when(F.col("_found").isNotNull(), F.char_length(text).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return docs.join(found, mine, "left").select(*[new[c].alias(c) if c in new else c for c in docs.columns])


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with their topic, tokens, probability and weight."""
    new, text = ("topic", "n_tokens", "probability", "weight"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = {"_id": F.col("doc_id").cast("long"), "_source": text("source"), "_lang": text("lang"), "_text": F.sha2(text("text"), 256)}
    mixed = mix(docs).where("kept").withColumnRenamed("text_sha256", "text")
    mixed = mixed.select(F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("source", "lang", "text", *new)]).dropDuplicates(list(key))
    same = [v.eqNullSafe(mixed[k]) for k, v in key.items()]
    return docs.join(mixed, same[0] & same[1] & same[2] & same[3]).select(*[c for c in docs.columns if c not in new], *[F.col(f"_{c}").alias(c) for c in new])


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mixing", sample_mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    common.shared_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline/{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}_{name}")
        docs = spark.read.parquet(f"{base}/{i}_{name}")
    return docs


#: The models and graph searches of the stages can't be written as SQL. tests/llm compares near-duplicates, passages, secrets and the
#: mixture with plain versions, and holds toxicity to its operator's scores.
ORACLE_SQL = None
