"""Gold cases for evaluation, one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions.text import trimmed
from ragspark.operators.planning import ROUTES

SCHEMA = (
    "id string, datasetId long, history array<struct<role:string,content:string>>, question string, expectedRoute string, "
    "relevantEvidence array<struct<documentName:string,contains:array<string>>>, expectNoEvidence boolean, _bad string"
)


def parse_cases(lines: DataFrame, default_dataset: int | None = None) -> DataFrame:
    """Cases of ``lines`` (value), blank ones left out, with ``errors``: sorted names of all that is wrong with each."""
    rows = lines.where(trimmed(F.col("value")) != "").select("value", F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_bad"}).alias("c"))
    rows = rows.select("value", "c.*").withColumn("datasetId", F.coalesce("datasetId", F.lit(default_dataset).cast("long")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(trimmed(F.col("id"))).orderBy("value")))
    blank = lambda c: trimmed(F.coalesce(F.col(c), F.lit(""))) == ""
    some = F.size(F.coalesce("relevantEvidence", F.expr("array()"))) > 0
    bad_marker = F.exists("relevantEvidence", lambda e: (trimmed(F.coalesce(e["documentName"], F.lit(""))) == "") | (F.coalesce(F.size(e["contains"]), F.lit(0)) <= 0) | F.exists(e["contains"], lambda m: trimmed(m) == ""))
    bad_role = F.exists("history", lambda m: ~F.coalesce(m["role"], F.lit("")).isin("user", "assistant"))
    none = F.coalesce("expectNoEvidence", F.lit(False))
    checks = {
        "bad JSON": F.col("_bad").isNotNull(), "blank id": blank("id"), "duplicate id": ~blank("id") & (F.col("_n") > 1), "blank question": blank("question"),
        "unknown route": ~F.coalesce("expectedRoute", F.lit("")).isin(*ROUTES), "no dataset": F.coalesce("datasetId", F.lit(0)) <= 0, "no evidence declared": ~some & ~none,
        "contradictory evidence": some & none, "empty marker": F.coalesce(bad_marker, F.lit(False)), "bad history role": F.coalesce(bad_role, F.lit(False)),
    }
    broken = F.col("_bad").isNotNull()
    errors = F.array_compact(F.array(*[F.when(test if name == "bad JSON" else ~broken & test, name) for name, test in sorted(checks.items())]))
    return rows.withColumn("errors", errors).drop("_bad", "_n")


def load_cases(spark: SparkSession, path: str, strict: bool = True, default_dataset: int | None = None) -> DataFrame:
    """Valid cases of JSONL files.  ``strict`` raises if any line is not valid, with the first of them."""
    cases = parse_cases(spark.read.text(path), default_dataset)
    if strict and (bad := cases.where("size(errors) > 0").select("id", "errors").take(3)):
        raise ValueError(f"invalid cases: {[(r.id, r.errors) for r in bad]}")
    return cases.where("size(errors) = 0").drop("errors", "value")


def evidence_of(cases: DataFrame) -> DataFrame:
    """case_id, evidence_no, document_name, contains."""
    return cases.select(F.col("id").alias("case_id"), F.posexplode("relevantEvidence").alias("evidence_no", "e")).select("case_id", "evidence_no", F.col("e.documentName").alias("document_name"), "e.contains")
