"""Offline evaluation: evidence matching and the metrics over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions.text import trimmed
from ragspark.operators.planning import ROUTES


def rate(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def evidence_match(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that prove an evidence: case_id, evidence_no, rank, chunk_id.

    evidence: case_id, evidence_no, document_name, contains array<string>; hits: case_id, rank, chunk_id, document_name,
    content.  Names agree without case and outer space; every marker must be in the content, case ignored.
    """
    name = lambda c: F.lower(trimmed(F.col(c)))
    e = evidence.select("case_id", "evidence_no", name("document_name").alias("_name"), "contains")
    h = hits.select("case_id", "rank", "chunk_id", name("document_name").alias("_name"), F.lower("content").alias("_text"))
    both = e.join(h, ["case_id", "_name"])
    return both.where(F.forall("contains", lambda m: F.contains(F.col("_text"), F.lower(trimmed(m))))).select("case_id", "evidence_no", "rank", "chunk_id")


def evidence_metrics(evidence: DataFrame, matches: DataFrame) -> DataFrame:
    """Hit@1/3/5, Recall@5/10, MRR@10 and NDCG@10 of each case that has evidence.

    Each evidence counts at its first rank; a rank that proves several counts once towards the gain.
    """
    first = matches.groupBy("case_id", "evidence_no").agg(F.min("rank").alias("r"))
    gains = first.where("r <= 10").groupBy("case_id", "r").agg(F.count(F.lit(1)).alias("_n")).groupBy("case_id").agg(F.sum(1 / F.log2(F.col("r") + 1.0)).alias("dcg"))
    found = first.groupBy("case_id").agg(F.min("r").alias("best"), F.count_if(F.col("r") <= 5).alias("in5"), F.count_if(F.col("r") <= 10).alias("in10"), F.count(F.lit(1)).alias("matched"))
    n = evidence.groupBy("case_id").agg(F.count_distinct("evidence_no").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    hit = lambda k: F.when(F.col("best") <= k, 1.0).otherwise(0.0)
    rows = n.join(found, "case_id", "left").join(gains, "case_id", "left")
    return rows.select(
        "case_id", hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"), hit(5).alias("hit_at_5"), rate(F.coalesce("in5", F.lit(0)), F.col("n")).alias("recall_at_5"),
        rate(F.coalesce("in10", F.lit(0)), F.col("n")).alias("recall_at_10"), F.when(F.col("best") <= 10, 1.0 / F.col("best")).otherwise(0.0).alias("mrr_at_10"),
        F.least(F.coalesce("dcg", F.lit(0.0)) / ideal, F.lit(1.0)).alias("ndcg_at_10"), (F.col("n") - F.coalesce("matched", F.lit(0))).alias("missing"),
    )


# results: run, case_id, expected_route, actual_route, route_correct, fallback, expect_no_evidence, has_evidence, no_hit,
# retrieval_performed, the metrics above, route_error, retrieval_error, execution_error (null or '' for none), *_ms


def _ok(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def route_confusion(results: DataFrame) -> DataFrame:
    """expected_route, actual_route, n; rows without a route are left out."""
    return results.where(_ok("route_error")).groupBy("expected_route", "actual_route").agg(F.count(F.lit(1)).alias("n"))


def route_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """evaluated, correct, accuracy, unsafe_none_rate and macro_f1, over all rows or for each group of ``by``.

    Macro-F1 is over the routes that are expected somewhere in the group.
    """
    by = by or []
    ok = results.where(_ok("route_error")).withColumn("_all", F.lit(1))
    keys = ["_all", *by]
    risky = F.col("expected_route") != "none"
    base = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("route_correct").alias("correct"), F.count_if(risky).alias("_risky"), F.count_if(risky & (F.col("actual_route") == "none")).alias("_unsafe"))
    n = ok.groupBy(*keys, "expected_route", "actual_route").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("expected_route") == F.col("actual_route")
    rows = n.groupBy(*keys, F.col("expected_route").alias("route")).agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~same, F.col("n")).otherwise(0)).alias("fn"))
    cols = n.where(~same).groupBy(*keys, F.col("actual_route").alias("route")).agg(F.sum("n").alias("fp"))
    f1 = rate(2 * F.col("tp"), 2 * F.col("tp") + F.coalesce("fp", F.lit(0)) + F.col("fn"))
    macro = rows.join(cols, [*keys, "route"], "left").groupBy(*keys).agg(F.avg(f1).alias("macro_f1"))
    out = base.join(macro, keys).select(*by, "evaluated", "correct", rate(F.col("correct"), F.col("evaluated")).alias("accuracy"), rate(F.col("_unsafe"), F.col("_risky")).alias("unsafe_none_rate"), "macro_f1")
    return out


RETRIEVAL = ("hit_at_1", "hit_at_3", "hit_at_5", "recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_10")


def retrieval_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over rows that ran and have evidence, and the rate of no hits over rows that expect none."""
    ok = results.where(_ok("execution_error"))
    means = [F.coalesce(F.avg(F.when(F.col("has_evidence"), F.col(m))), F.lit(0.0)).alias(m) for m in RETRIEVAL]
    negative = F.coalesce(F.avg(F.when(F.col("expect_no_evidence"), F.col("no_hit").cast("double"))), F.lit(0.0))
    return ok.groupBy(*(by or [])).agg(F.count_if("has_evidence").alias("evaluated_evidence"), *means, F.count_if("expect_no_evidence").alias("negative_evaluated"), negative.alias("negative_no_hit_rate"))


#: groups and percentiles up to which their ranges are held by the driver
MOST_TARGETS = 100_000


def nearest_ranks(values: DataFrame, by: list[str], value: str, ps: list[float], bins: int = 1024, most: int = 4096) -> DataFrame:
    """The columns ``by``, p, and the value of nearest rank (the ceil(p n)-th of n), exact, without a group in one task.

    Ranges are refined by counts: a pass counts the values of each range by ``bins`` parts of equal width, and goes on with
    the part that holds the rank, from its least to its greatest value, until that is one value or it has at most ``most``
    values, which are then sorted.  Two or three passes will do, as each divides a range by ``bins``.  Nulls and NaN don't
    count; groups without values are left out.  The ranges of all groups must be few (``MOST_TARGETS``): they are broadcast.
    """
    spark = values.sparkSession
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    found = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    found = found.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    found = found.withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("_n"), 6))).cast("long")).select(*by, "p", "_lo", "_hi", "_n", "_rank")
    schema, done = found.schema, []
    while True:
        told = found.limit(MOST_TARGETS + 1).collect()
        if len(told) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} groups")
        wide = [r for r in told if r["_lo"] < r["_hi"] and r["_n"] > most]
        done += [r for r in told if not (r["_lo"] < r["_hi"] and r["_n"] > most)]
        if not wide:
            break
        part = rows.join(F.broadcast(spark.createDataFrame(wide, schema).drop("_n")), by).where("_v BETWEEN _lo AND _hi")
        half = lambda c: F.col(c) / 2  # noqa: E731  the width of a range may be no double
        share = F.floor((half("_v") - half("_lo")) / (half("_hi") - half("_lo")) * bins)
        counts = part.groupBy(*by, "p", "_rank", F.least(share, F.lit(bins - 1)).alias("_bin")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*by, "p").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most ``bins`` rows
        counts = counts.withColumn("_upto", upto).where("_upto >= _rank AND _upto - _n < _rank")
        found = counts.withColumn("_rank", F.col("_rank") - (F.col("_upto") - F.col("_n"))).select(*by, "p", "_lo", "_hi", "_n", "_rank")
    targets = spark.createDataFrame(done, schema)
    few = rows.join(F.broadcast(targets.where("_lo < _hi").drop("_n")), by).where("_v BETWEEN _lo AND _hi").groupBy(*by, "p", "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_few"))
    few = few.select(*by, "p", F.get("_few", F.col("_rank").cast("int") - 1).alias(value))
    return targets.where("_lo = _hi").select(*by, "p", F.col("_lo").alias(value)).unionByName(few)


def latency_stats(results: DataFrame) -> DataFrame:
    """stage, mean, p50, p95 (nearest rank, exact) of route, retrieval and total times; retrieval only where it was done."""
    times = F.explode(
        F.array(
            F.struct(F.lit("route").alias("stage"), F.col("route_ms").alias("ms")), F.struct(F.lit("total").alias("stage"), F.col("total_ms").alias("ms")),
            F.struct(F.lit("retrieval").alias("stage"), F.when(F.col("retrieval_performed"), F.col("retrieval_ms")).alias("ms")),
        )
    )
    long_ = results.select(times.alias("x")).select("x.stage", "x.ms")
    ranks = nearest_ranks(long_, ["stage"], "ms", [0.5, 0.95]).groupBy("stage").agg(*[F.max(F.when(F.col("p") == p, F.col("ms"))).alias(n) for p, n in ((0.5, "p50_ms"), (0.95, "p95_ms"))])
    means = long_.groupBy("stage").agg(F.coalesce(F.avg("ms"), F.lit(0.0)).alias("mean_ms"))
    return means.join(F.broadcast(ranks), "stage", "left").select("stage", "mean_ms", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50_ms", "p95_ms")])


def route_stability(results: DataFrame) -> DataFrame:
    """evaluated_cases, stable_cases, rate: cases whose runs all took one route."""
    cases = results.where(_ok("route_error")).groupBy("case_id").agg((F.count_distinct("actual_route") == 1).alias("stable"))
    out = cases.agg(F.count(F.lit(1)).alias("evaluated_cases"), F.count_if("stable").alias("stable_cases"))
    return out.withColumn("rate", rate(F.col("stable_cases"), F.col("evaluated_cases")))


def eval_summary(cases: DataFrame, results: DataFrame) -> DataFrame:
    """cases, attempts, errors."""
    a = cases.agg(F.count(F.lit(1)).alias("cases"))
    b = results.agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~_ok("execution_error")).alias("errors"))
    return a.crossJoin(b)  # one row each


def summary_by_route(cases: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each of the four routes, also for those without cases."""
    spark = results.sparkSession
    routes = spark.createDataFrame([(r,) for r in ROUTES], "expected_route string")
    n = cases.groupBy("expected_route").agg(F.count(F.lit(1)).alias("cases"))
    tries = results.groupBy("expected_route").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~_ok("execution_error")).alias("errors"))
    out = routes.join(n, "expected_route", "left").join(tries, "expected_route", "left")
    out = out.join(route_metrics(results, ["expected_route"]), "expected_route", "left").join(retrieval_metrics(results, ["expected_route"]), "expected_route", "left")
    return out.na.fill(0)


def failed_cases(results: DataFrame) -> DataFrame:
    """Results with an error, a wrong route, missing evidence, or hits where none are expected; by case and run."""
    wrong = ~_ok("execution_error") | ~F.col("route_correct") | (F.col("missing") > 0) | (F.col("expect_no_evidence") & ~F.col("no_hit"))
    return results.where(wrong).orderBy("case_id", "run")
