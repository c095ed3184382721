"""Exact deduplication: sorted digest runs, exchanged and merged in binomial rounds (operator 6).

Every row has a digest of its normalised text and starts in one of ``runs`` runs.  In each round the runs swap the
rows whose digest belongs to another run: the next bits of a row's run number are replaced by those of its digest, so
``fan_in`` runs meet, are merged by digest, and keep the best row and the number of rows of each digest.  After
log(runs)/log(fan_in) rounds each digest is in one run.  A group of copies, however large, enters the first round as at
most one row a run and shrinks by ``fan_in`` each round; no task ever gets the rows of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

_BLANKS = " \t\n\x0b\x0c\r"


def _digests(docs: DataFrame, runs: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, _BLANKS, "")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("_chars"), F.xxhash64("text").alias("text_hash"), plain.alias("_plain"))
    return out.select(
        "doc_id", "_chars", "text_hash", F.unhex(F.sha2(F.col("_plain"), 256)).alias("_digest"),
        F.xxhash64("_plain").alias("_check"), F.octet_length("_plain").cast("long").alias("_bytes"),
        F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(runs)).cast("int").alias("_run"), F.monotonically_increasing_id().alias("_row"),
    )


#: Texts are the same when all three agree: a match of the digest alone is not taken for granted.
_SAME = ["_digest", "_check", "_bytes"]


def mark_duplicates(docs: DataFrame, runs: int = 256, fan_in: int = 16) -> DataFrame:
    """Group ``docs`` (doc_id, text) by text without white space; one row for each input row.

    Returns doc_id, keep_id, group_size, kept, text_sha256, text_hash (xxhash64 of the text as it is).  Of equal texts the one with the most code points before
    normalisation stays, then the smallest doc_id.  A null text is the empty text; all empty texts are equal.  A null
    doc_id comes after all others (keep_id is null only if the group has no other); rows that repeat both doc_id and
    text count each, and one of them stays.  Other columns are ignored, whatever their names.  An empty table gives an empty
    result.  ``runs`` and ``fan_in`` are powers of two.
    """
    rows = cut(_digests(docs, runs))
    best = F.struct((-F.col("_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    merged = rows.groupBy("_run", *_SAME).agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("_n"))
    first = merged.select("_run", *_SAME)
    bits, step, done = runs.bit_length() - 1, fan_in.bit_length() - 1, 0
    while done < bits:
        take = min(step, bits - done)
        mask = ((1 << take) - 1) << done
        moved = F.col("_run").bitwiseAND(F.lit(~mask)).bitwiseOR(F.col("_check").bitwiseAND(F.lit(mask)).cast("int"))
        merged = merged.withColumn("_run", moved).groupBy("_run", *_SAME).agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n"))
        done += take
    merged = cut(merged.drop("_run"))
    # back down the tree: a digest has at most one row a run here, so copies are spread over the runs
    told = first.join(merged, _SAME)
    out = rows.join(told, ["_run", *_SAME])
    kept = F.col("_row") == F.col("_best.row")
    return out.select("doc_id", F.col("_best.id").alias("keep_id"), F.col("_n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"), "text_hash")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS p FROM documents),
     d AS (SELECT doc_id, length(t) AS chars, sha256(p) AS text_sha256 FROM n),
     g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  row_number() OVER w = 1 AS kept FROM d
           WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""
