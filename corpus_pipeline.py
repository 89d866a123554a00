"""A corpus pipeline of the training-data operators: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from siltstone.llm.common import attach, materialise, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL expresses neither the classifier nor the tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
#: Dropped ids up to this number (8 bytes each, and overhead) are broadcast.
BROADCAST_IDS = 500_000


#: Bytes of a batch that a Python worker gets at once, where the session has Spark's own default.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded(spark: SparkSession) -> None:
    """Executors hold a heap and several workers side by side: batches of texts are kept small on both ends."""
    if spark.conf.get(BATCH_SETTING) == f"{64 << 20}b":
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go. Scores ride on the rows; nothing is joined.

    Null and empty texts score as texts without words, rows without an id are scored like others, repeated rows score
    the same. Without toxic labels all stay.
    """
    _bounded(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("toxicity < 0.5").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays; of repeated rows of an id, one row for each text that stays. Null texts are
    equal to empty ones and to white space."""
    _bounded(spark)
    verdict = materialise(exact_dedup.exact_dedup(docs).select("doc_id", "text_sha256", "kept"), "verdict")
    ids = verdict.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    twice = materialise(ids.filter("n > 1").select("doc_id"), "repeated")
    gone = ids.filter("n = 1 and not kept").select("doc_id").union(twice)
    once = _without(docs, gone.select(F.col("doc_id").alias("gone_id")), lambda g: F.col("doc_id").eqNullSafe(F.col("gone_id")))
    if not twice.limit(1).collect():
        return once
    sha = F.sha2(exact_dedup.normalised(F.coalesce("text", F.lit(""))), 256)
    rows = docs.withColumn("_sha", sha).join(twice.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    keep = verdict.filter("kept").select(F.col("doc_id").alias("_id"), "text_sha256")
    rows = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("text_sha256")), "left_semi")
    longest = rows.groupBy("doc_id", "_sha").agg(F.max_by(F.struct(*COLUMNS), F.length("text")).alias("row"))
    return once.unionByName(longest.select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, null ids last, then that with the smallest hash of
    its text. Rows are told apart by id and text, so that null or repeated ids save no copy; rows equal in both stay
    together. Null and empty texts have no near copies and stay."""
    _bounded(spark)
    found = materialise(near_dedup.grouped(docs, 85).filter("group is not null").select("doc_id", "h", "group"), "near-verdict")
    first = found.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first"))
    first = materialise(first.filter("n > 1").select("group", "n", "first"), "near-first")
    # a group may hold a third of all rows
    rows = attach(found, first, "group", "n", F.xxhash64("doc_id", "h"))
    gone = rows.filter("first is not null").filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))))
    hashed = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    return _without(hashed, gone, lambda g: F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("_h") == F.col("gone_h")))


def _without(docs: DataFrame, gone: DataFrame, same: Callable[[DataFrame], Column]) -> DataFrame:
    """docs without the rows of ``gone``, which are written first and broadcast only if they are few."""
    gone = materialise(gone, "dropped")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same(gone), "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, and n_chars counted anew; every document stays, null texts stay null."""
    return secrets.redact(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 1024 tokens: one row per piece. A null or empty text is its end id alone;
    rows without an id and repeated rows are documents of their own."""
    import public_tokenizers

    _bounded(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents; one row per packed piece.

    Stages hand on the columns of documents and no others. What each does with null ids and texts, repeated rows and ties
    is in its own description; very long texts go through whole; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
