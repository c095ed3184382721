"""Queries over the results of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.operators import evaluation

from .tables import CASES_SQL, RESULTS_SQL, cases, query, results


@query(f"WITH {RESULTS_SQL} SELECT expected_route, actual_route, count(*) AS n FROM results WHERE route_error = '' GROUP BY 1, 2")
def route_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.route_confusion(results(spark, d))


def _route_sql(by: str = "") -> str:
    k, g, j = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON true")
    return f"""ok AS (SELECT * FROM results WHERE route_error = ''),
 base AS (SELECT {k}count(*) AS evaluated, count(*) FILTER (route_correct) AS correct, coalesce(count(*) FILTER (expected_route <> 'none' AND actual_route = 'none') / nullif(count(*) FILTER (expected_route <> 'none'), 0), 0) AS unsafe FROM ok {g}),
 rows_ AS (SELECT expected_route AS route, count(*) FILTER (route_correct) AS tp, count(*) FILTER (NOT route_correct) AS fn FROM ok GROUP BY 1),
 cols_ AS (SELECT actual_route AS route, count(*) AS fp FROM ok WHERE NOT route_correct GROUP BY 1),
 f1 AS (SELECT avg(2 * tp / (2 * tp + coalesce(fp, 0) + fn)) AS macro FROM rows_ LEFT JOIN cols_ USING (route))"""


@query(f"WITH {RESULTS_SQL}, {_route_sql()} SELECT evaluated, correct, round(correct / evaluated, 6) AS accuracy, round(unsafe, 6) AS unsafe_none_rate, round(macro, 6) AS macro_f1 FROM base, f1")
def route_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.route_metrics(results(spark, d))
    return out.select("evaluated", "correct", *[F.round(c, 6).alias(c) for c in ("accuracy", "unsafe_none_rate", "macro_f1")])


_MEANS = ", ".join(f"round(coalesce(avg({m}) FILTER (has_evidence), 0), 6) AS {m}" for m in evaluation.RETRIEVAL)


@query(f"WITH {RESULTS_SQL} SELECT count(*) FILTER (has_evidence) AS evaluated_evidence, {_MEANS}, count(*) FILTER (expect_no_evidence) AS negative_evaluated, round(avg(CASE WHEN no_hit THEN 1.0 ELSE 0.0 END) FILTER (expect_no_evidence), 6) AS negative_no_hit_rate FROM results WHERE execution_error = ''")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.retrieval_metrics(results(spark, d))
    return out.select("evaluated_evidence", *[F.round(m, 6).alias(m) for m in evaluation.RETRIEVAL], "negative_evaluated", F.round("negative_no_hit_rate", 6).alias("negative_no_hit_rate"))


@query(
    f"""WITH {RESULTS_SQL}, x AS (SELECT 'route' AS stage, route_ms AS ms FROM results UNION ALL SELECT 'total', total_ms FROM results UNION ALL SELECT 'retrieval', CASE WHEN retrieval_performed THEN retrieval_ms END FROM results)
 SELECT stage, round(avg(ms), 6) AS mean_ms, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms FROM x GROUP BY 1"""
)
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency_stats(results(spark, d)).withColumn("mean_ms", F.round("mean_ms", 6))


@query(f"WITH {RESULTS_SQL}, c AS (SELECT case_id, count(DISTINCT actual_route) = 1 AS stable FROM results WHERE route_error = '' GROUP BY 1) SELECT count(*) AS evaluated_cases, count(*) FILTER (stable) AS stable_cases, round(count(*) FILTER (stable) / count(*), 6) AS rate FROM c")
def route_stability(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.route_stability(results(spark, d)).withColumn("rate", F.round("rate", 6))


@query(f"WITH {RESULTS_SQL} SELECT (SELECT count(*) FROM benchmark) AS cases, count(*) AS attempts, count(*) FILTER (execution_error <> '') AS errors FROM results")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.eval_summary(cases(spark, d), results(spark, d))


@query(
    f"""WITH {RESULTS_SQL}, {CASES_SQL}, routes AS (SELECT unnest(['none', 'direct', 'contextual_rewrite', 'decomposition']) AS expected_route),
 c AS (SELECT expected_route, count(*) AS cases FROM cases GROUP BY 1), a AS (SELECT expected_route, count(*) AS attempts, count(*) FILTER (execution_error <> '') AS errors FROM results GROUP BY 1),
 r AS (SELECT expected_route, count(*) AS evaluated, count(*) FILTER (route_correct) AS correct FROM results WHERE route_error = '' GROUP BY 1),
 m AS (SELECT expected_route, coalesce(avg(mrr_at_10) FILTER (has_evidence), 0) AS mrr FROM results WHERE execution_error = '' GROUP BY 1)
 SELECT expected_route, coalesce(cases, 0) AS cases, coalesce(attempts, 0) AS attempts, coalesce(errors, 0) AS errors, coalesce(evaluated, 0) AS evaluated, round(coalesce(correct / evaluated, 0), 6) AS accuracy,
  round(coalesce(2 * correct / (2 * correct + evaluated - correct), 0), 6) AS macro_f1, round(coalesce(mrr, 0), 6) AS mrr_at_10
 FROM routes LEFT JOIN c USING (expected_route) LEFT JOIN a USING (expected_route) LEFT JOIN r USING (expected_route) LEFT JOIN m USING (expected_route)"""
)
def summary_by_route(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.summary_by_route(cases(spark, d), results(spark, d))
    return out.select("expected_route", "cases", "attempts", "errors", "evaluated", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "mrr_at_10")])


@query(f"WITH {RESULTS_SQL} SELECT case_id, run, execution_error, route_correct, missing FROM results WHERE execution_error <> '' OR NOT route_correct OR missing > 0 OR (expect_no_evidence AND NOT no_hit)")
def failed_cases(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.failed_cases(results(spark, d)).select("case_id", "run", "execution_error", "route_correct", "missing")
