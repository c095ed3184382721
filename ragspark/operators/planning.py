"""Query plans from stored router answers: parsing, validation, fallback and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.text import strip_fence, trimmed, truncated

ROUTES = ("none", "direct", "contextual_rewrite", "decomposition")
LONGEST_QUERY = 200
MOST_DERIVED = 4


def distinct_queries(queries: Column, limit: int) -> Column:
    """Trimmed, without blanks, texts over 200 characters and repeats (case ignored), the first ``limit``."""
    clean = F.filter(F.transform(F.coalesce(queries, F.expr("cast(array() as array<string>)")), trimmed), lambda q: q.isNotNull() & (q != "") & (F.length(q) <= LONGEST_QUERY))
    lower = F.transform(clean, lambda q: F.lower(q))
    fresh = F.filter(F.transform(clean, lambda q, i: F.when(F.array_position(lower, F.lower(q)) == i + 1, q)), lambda q: q.isNotNull())
    return F.slice(fresh, 1, limit)


def parse_decision(response: Column) -> Column:
    """struct(queryType, queries) of a router's answer, null when it is no JSON object; a code fence about it is dropped."""
    return F.from_json(strip_fence(response), "queryType string, queries array<string>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def query_plan(cases: DataFrame, most: int = MOST_DERIVED) -> DataFrame:
    """cases: case_id, question, response.  Adds query_type, queries (what to retrieve with, in order), fallback and error.

    none retrieves nothing, direct the question, contextual_rewrite the question and one other, decomposition the question
    and at least two.  Anything that breaks this, an unknown type, a blank question or an answer that can't be read, falls
    back to direct.
    """
    most = most if 2 <= most <= 4 else 4
    d = cases.withColumn("_d", parse_decision(F.col("response"))).withColumn("_q", trimmed(F.coalesce("question", F.lit(""))))
    kind = trimmed(F.coalesce(F.col("_d.queryType"), F.lit("")))
    d = d.withColumn("_kind", kind).withColumn("_derived", distinct_queries(F.col("_d.queries"), most))
    n = F.size("_derived")
    error = (
        F.when(F.col("response").isNull() | F.col("_d").isNull() | F.col("_d._bad").isNotNull(), "not JSON")
        .when(~F.col("_kind").isin(*ROUTES), "unknown type")
        .when((F.col("_kind") == "contextual_rewrite") & (n != 1), "a rewrite needs one query")
        .when((F.col("_kind") == "decomposition") & (n < 2), "a decomposition needs two queries")
        .when(F.col("_q") == "", "blank question")
    )
    d = d.withColumn("error", error).withColumn("query_type", F.when(error.isNull(), F.col("_kind")).otherwise("direct"))
    none = F.expr("cast(array() as array<string>)")
    fan = distinct_plan(F.col("_q"), F.col("_derived"), most)
    queries = F.when((F.col("query_type") == "none") | (F.col("_q") == ""), none).when(F.col("query_type") == "direct", F.array("_q")).otherwise(fan)
    return d.withColumn("queries", queries).withColumn("fallback", F.col("error").isNotNull()).drop("_d", "_q", "_kind", "_derived")


def distinct_plan(question: Column, derived: Column, most: int) -> Column:
    others = F.filter(derived, lambda q: F.lower(q) != F.lower(question))
    return F.concat(F.array(question), F.slice(others, 1, most))


def router_history(messages: DataFrame) -> DataFrame:
    """Turns that the router sees: user's and assistant's, cut to 300 characters, without blank ones."""
    content = trimmed(truncated(F.col("content"), 300))
    return messages.where(F.col("role").isin("user", "assistant")).withColumn("content", content).where("content <> ''")
