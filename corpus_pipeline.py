"""A training corpus from ``documents``: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from ragspark.llm.common import cut, table

#: rows up to which the list of dropped documents is broadcast; a longer one is joined by shuffle
MOST = 1_000_000


def spare(docs: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that ``docs`` has."""
    out = []
    for name in names:
        while name.lower() in (c.lower() for c in docs.columns):
            name = f"_{name}"
        out.append(name)
    return out


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text (text_hash, its xxhash64) are in ``dropped``.  Null ids are equal; columns of any name are kept."""
    id_, hash_ = spare(docs, "id", "hash")
    dropped = cut(dropped.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct())
    if dropped.count() <= MOST:
        dropped = F.broadcast(dropped)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    return docs.join(dropped, same, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least 0.7.

    A null text is scored as an empty one; rows that repeat have one score and stay or go together; a null id learns
    nothing.  An empty table stays empty.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score, good = spare(docs, "score", "good")
    return quality.score(docs, model, keep=docs.columns, names=(score, good)).where(F.col(good) == 1).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then that with the smallest id, null after all others.

    Null and empty texts are equal.  Of rows that repeat their id and text, one stays.  An empty table stays empty.
    """
    kept = without(docs, exact_dedup.mark_duplicates(docs).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept")).where("not kept"))
    # rows that repeat their id, or have none, are kept all: one of them stays
    (key,) = spare(docs, "plain")
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), exact_dedup._BLANKS, "")
    return kept.withColumn(key, F.sha2(plain, 256)).dropDuplicates([key]).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies, null after all others; of equal ids, that with the smallest hash of the text.

    Texts without words, null ones too, are alone.  Rows that repeat both id and text count as one and stay together.  An
    empty table stays empty.
    """
    id_, hash_, row = spare(docs, "id", "hash", "key")
    # a key for each row, in this order
    keys = docs.select(F.col("doc_id").cast("long").alias(id_), F.xxhash64("text").alias(hash_)).distinct().orderBy(F.col(id_).asc_nulls_last(), hash_)
    keys = cut(keys.withColumn(row, F.monotonically_increasing_id()))
    told = F.broadcast(keys) if keys.count() <= MOST else keys
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    keyed = docs.join(told, same).select(F.col(row).alias("doc_id"), "text")
    dropped = jaccard_join.link(keyed).where("doc_id <> component_id").select(F.col("doc_id").alias(row))
    return without(docs, keys.join(dropped, row).select(F.col(id_).alias("doc_id"), F.col(hash_).alias("text_hash")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark.  Null and empty texts share none; rows that repeat stay or go together; an empty table stays empty."""
    return without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of tokens.  A null text is the end token alone; rows that repeat are packed each; an empty table gives no piece."""
    # words that a worker remembers stay in its memory, which the other stages need
    return packing.pack_documents(docs, remember=1 << 20)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: a trained classifier and a tokenizer are not SQL; tests/llm hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
