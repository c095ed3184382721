"""Counts, registration, attempts, schedules: the corpus's books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def owned_documents(documents: DataFrame, datasets: DataFrame, users: DataFrame) -> DataFrame:
    """Documents of datasets that belong to ``users`` (user_id)."""
    return documents.join(datasets.join(users, "user_id", "left_semi").select("dataset_id"), "dataset_id", "left_semi")


def chunk_listing(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of ``documents`` (document_id) in order, without their vectors."""
    columns = [c for c in chunks.columns if c != "embedding"]
    return chunks.select(*columns).join(documents.select("document_id").distinct(), "document_id", "left_semi").orderBy("document_id", "chunk_index")


def asset_keys(chunks: DataFrame) -> DataFrame:
    return chunks.where("image_key <> ''").select("image_key")


def unbound_owners(datasets: DataFrame) -> DataFrame:
    """Users with a dataset that has no embedding model."""
    return datasets.where(F.coalesce("embed_model_id", F.lit(0)) == 0).select("user_id").distinct()


def bind_models(datasets: DataFrame, default: int) -> DataFrame:
    return datasets.withColumn("embed_model_id", F.when(F.coalesce("embed_model_id", F.lit(0)) == 0, default).otherwise(F.col("embed_model_id")))


def model_usage(datasets: DataFrame) -> DataFrame:
    return datasets.where(F.coalesce("embed_model_id", F.lit(0)) != 0).groupBy("user_id", "embed_model_id").agg(F.count(F.lit(1)).alias("n"))


def dataset_stats(datasets: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks of each dataset, 0 where there are none."""
    d = documents.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("documents"))
    c = chunks.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("chunks"))
    return datasets.select("dataset_id").join(d, "dataset_id", "left").join(c, "dataset_id", "left").na.fill(0)


def document_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    c = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return documents.select("document_id").join(c, "document_id", "left").na.fill(0)


def fingerprint(df: DataFrame, content: str) -> DataFrame:
    """Adds file_hash, the sha256 of ``content`` in hex."""
    return df.withColumn("file_hash", F.sha2(F.col(content), 256))


def register_documents(documents: DataFrame) -> DataFrame:
    """Which document an upload is: the first of the same dataset and hash; uploads without a hash are always new.

    Adds registered_id and is_new.
    """
    empty = F.coalesce("file_hash", F.lit("")) == ""
    same = Window.partitionBy("dataset_id", "file_hash", F.when(empty, F.col("document_id")))  # those without a hash are no group
    first = F.when(empty, F.col("document_id")).otherwise(F.min("document_id").over(same))
    return documents.withColumn("registered_id", first).withColumn("is_new", F.col("registered_id") == F.col("document_id"))


def parse_attempts(events: DataFrame) -> DataFrame:
    """Highest attempt, and the last error, of each document and version."""
    return events.groupBy("document_id", "parse_version").agg(F.max("attempt").alias("attempt"), F.max_by("error", F.struct("attempted_at", "event_id")).alias("last_error"))


def due_backlog(events: DataFrame, now: str) -> DataFrame:
    """Events that wait and are due, or are being worked on longer than their lease, by id."""
    at = F.lit(now).cast("timestamp")
    due = ((F.col("status") == "pending") & (F.col("due_at") <= at)) | ((F.col("status") == "processing") & (F.col("lease_until") <= at))
    return events.where(due).orderBy("event_id")


def retention(events: DataFrame, now: str, published_hours: int = 168, dead_days: int = 7) -> DataFrame:
    """What stays: published rows of the last hours, dead letters of the last days, all others."""
    at = F.lit(now).cast("timestamp")
    old = ((F.col("status") == "published") & (F.col("ts") < at - F.expr(f"INTERVAL {published_hours} HOURS"))) | ((F.col("status") == "dead") & (F.col("ts") < at - F.expr(f"INTERVAL {dead_days} DAYS")))
    return events.where(~old)
