"""Where results go: chunks, vectors, edits, reports.  Every write can be repeated with the same outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.text import token_estimate, trimmed

from .snapshots import Snapshots

MOST_DIMENSIONS = 4096


def replaced(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """``old`` chunks without those of ``documents`` (document_id), and ``new``."""
    return old.join(documents.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def replace_document_chunks(spark: SparkSession, path: str, new: DataFrame, documents: DataFrame) -> None:
    """Rebuild the chunks of ``documents`` in the table at ``path``, in one step: a failure leaves the table as it was."""
    Snapshots(spark, path).replace({"chunks": new}, documents, {"chunks": ["dataset_id"]})


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return Snapshots(spark, path).read("chunks")


def checked_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors with their dimension, rejects): dimensions must be from 1 to 4096."""
    sized = vectors.withColumn("dim", F.coalesce(F.size("embedding"), F.lit(0)))
    fine = (F.col("dim") >= 1) & (F.col("dim") <= MOST_DIMENSIONS)
    return sized.where(fine), sized.where(~fine)


def write_vectors(vectors: DataFrame, path: str, documents: DataFrame | None = None) -> DataFrame:
    """Add vectors (document_id, chunk_id, embedding) to the table at ``path``, by dimension, in one step; returns the rejects.

    Vectors that ``documents`` had before are replaced.
    """
    good, bad = checked_vectors(vectors)
    Snapshots(vectors.sparkSession, path).replace({"vectors": good}, documents, {"vectors": ["dim"]})
    return bad


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return Snapshots(spark, path).read("vectors")


def apply_chunk_edits(chunks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with edited contents and token counts, the changed ones): only the latter need new vectors.

    edits: chunk_id, content; blank edits don't count, of several of a chunk the largest edit_no does if there is one.
    """
    e = edits.withColumn("_new", trimmed(F.col("content"))).where("_new <> ''")
    last = F.max_by("_new", "edit_no") if "edit_no" in edits.columns else F.max("_new")
    e = e.groupBy("chunk_id").agg(last.alias("_new"))
    both = chunks.join(e, "chunk_id", "left").withColumn("_changed", F.col("_new").isNotNull() & (F.col("_new") != F.col("content")))
    both = both.withColumn("content", F.coalesce("_new", "content")).withColumn("token_num", F.when(F.col("_changed"), token_estimate(F.col("content"))).otherwise(F.col("token_num"))).drop("_new")
    return both.drop("_changed"), both.where("_changed").drop("_changed")


def write_report(results: DataFrame, summary: DataFrame, failures: DataFrame, path: str) -> None:
    """results and failures as JSON lines, the summary as Parquet."""
    results.write.mode("overwrite").json(f"{path}/results")
    failures.write.mode("overwrite").json(f"{path}/failures")
    summary.write.mode("overwrite").parquet(f"{path}/summary")
