"""Tool-call linking (operator 3): calls and results are joined by identifier, ordered by dependency, their arguments
checked against schemas, and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: tool -> argument -> (type as Spark names it for JSON values, required)
SCHEMAS = {
    "search": {"query": ("STRING", True), "limit": ("BIGINT", True)},
    "translate": {"text": ("STRING", True), "to": ("STRING", True)},
    "count": {"text": ("STRING", True), "limit": ("BIGINT", False)},
}


def _problems(schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted names of what is wrong with ``args`` (a variant) for ``tool``, comma-joined; empty when valid."""
    v = F.col("_args")
    kind = F.schema_of_variant(v)
    found = [F.when(F.col("arguments").isNull() | v.isNull() | ~kind.startswith("OBJECT"), F.lit("not an object"))]
    known = F.lit(False)
    for tool, fields in sorted(schemas.items()):
        mine = F.col("tool") == tool
        known = known | mine
        for name, (want, required) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
            absent = got.isNull() | (got == "VOID")
            if required:
                found.append(F.when(mine & kind.startswith("OBJECT") & absent, F.lit(f"{name}: missing")))
            found.append(F.when(mine & ~absent & (got != want), F.lit(f"{name}: not {want}")))
    found.append(F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown tool")))
    return F.array_join(F.array_sort(F.array_compact(F.array(*found))), ", ")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS, block: int = 256) -> DataFrame:
    """One row for each call, linked, ordered, checked and serialised.

    calls: conv_id long, turn long, call_id string, tool string, arguments string (JSON), after array<string> (calls it
    depends on), and role if there is one, which is kept.  results: call_id string, content string.  Returns conv_id, turn, call_id, tool, level, place, linked,
    valid, problems, call_json.  ``level`` is 0 for a call without known dependencies, else one more than the highest of
    them; dependencies on calls that do not exist are void; calls on a cycle, or behind one, get null as level
    and come last.  ``place`` numbers a conversation's calls from 0 in an order that puts each after those
    it depends on.  Of several results of one call the smallest content counts; of repeated call ids each row is a call.
    Null ids link with nothing.  Bad JSON (repeated keys too) and null arguments are 'not an object'; text that doesn't
    parse is kept as a JSON string.  Canonical JSON: keys sorted, no spaces.  Empty tables give an empty result; other columns are ignored.  No group is gathered: places are counted by
    blocks of ``block`` turns.
    """
    more = [c for c in ("role",) if c in calls.columns]
    calls = cut(calls.select("conv_id", "turn", "call_id", "tool", "arguments", "after", *more))
    links = calls.where("call_id is not null").select("call_id", F.explode("after").alias("on")).where("on is not null")
    ids = calls.where("call_id is not null").select("call_id").distinct()
    links = cut(links.join(ids.withColumnRenamed("call_id", "on"), "on").distinct())
    # levels from the bottom up: a call is placed in the round after its last dependency
    levels = cut(ids.join(links, "call_id", "left_anti").withColumn("level", F.lit(0)))
    frontier, left = levels, links
    level = 0
    while not frontier.isEmpty():  # calls on a cycle are never reached
        level += 1
        left = cut(left.join(frontier.select(F.col("call_id").alias("on")), "on", "left_anti"))
        waiting = left.select("call_id").distinct()
        frontier = cut(links.join(frontier.select(F.col("call_id").alias("on")), "on", "left_semi").select("call_id").distinct().join(waiting, "call_id", "left_anti").withColumn("level", F.lit(level)))
        levels = levels.unionByName(frontier)
    answer = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    rows = calls.join(levels, "call_id", "left").join(answer, "call_id", "left")
    rows = rows.withColumn("_args", F.try_parse_json("arguments")).withColumn("problems", _problems(schemas))
    message = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"), F.col("tool")), {"ignoreNullFields": "false"})
    raw = F.to_json(F.struct(F.col("arguments").alias("a")))
    raw = F.when(F.col("arguments").isNotNull(), F.substring(raw, F.lit(6), F.length(raw) - 6))
    body = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("_args"), raw, F.lit("null")), F.lit(","), F.substring(message, F.lit(2), F.length(message)))
    rows = cut(
        rows.select(
            "conv_id", "turn", "call_id", "tool", *more, "level", F.coalesce("linked", F.lit(False)).alias("linked"),
            (F.col("problems") == "").alias("valid"), "problems", body.alias("call_json"), F.floor(F.col("turn") / block).alias("_block"),
        )
    )
    part = ["conv_id", "level", "_block"]
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), F.col("_block").asc_nulls_last())
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    same = F.lit(True)
    for c in part:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("turn", "call_id", "call_json"))
    out = rows.withColumn("_place", place).alias("r").join(counts.alias("c"), same)
    return out.select(
        "r.conv_id", "r.turn", "r.call_id", "r.tool", "r.level", (F.col("_before") + F.col("_place") - 1).cast("long").alias("place"),
        "r.linked", "r.valid", "r.problems", "r.call_json", *[f"r.{c}" for c in more],
    )


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text) without tool calls of its own.

    Each turn that is not an assistant's is a call of its role, the turn after it, if an assistant's, is its result.  The tool goes by the turn, the
    arguments are made of the text, some of them against the schema (a number as text, a field left out).  A call
    depends on the one whose number within the conversation has the lowest set bit cleared.
    """
    ident = lambda turn: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), turn.cast("string"))
    turn, text = F.col("turn"), F.coalesce(F.col("text"), F.lit(""))
    k = F.floor(turn / 2)
    before = 2 * k.bitwiseAND(k - 1) + turn % 2
    tool = F.when(k % 3 == 0, "search").when(k % 3 == 1, "translate").otherwise("count")
    n = F.length(text)
    limit = F.when(n % 7 == 0, F.concat(F.lit('"'), (n % 50).cast("string"), F.lit('"'))).otherwise((n % 50).cast("string"))
    quoted = F.to_json(F.struct(text.alias("q")))
    string = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    args = (
        F.when(tool == "search", F.concat(F.lit('{"query": '), string, F.lit(', "limit": '), limit, F.lit("}")))
        .when((tool == "translate") & (n % 5 != 0), F.concat(F.lit('{"to": "en", "text": '), string, F.lit("}")))
        .when(tool == "translate", F.concat(F.lit('{"text": '), string, F.lit("}")))
        .otherwise(F.concat(F.lit('{"text": '), string, F.lit(', "limit": '), limit, F.lit("}")))
    )
    after = F.when(k > 0, F.array(ident(before))).otherwise(F.expr("array()").cast("array<string>"))
    calls = turns.where(~F.col("role").eqNullSafe("assistant")).select(
        F.col("conv_id").cast("long").alias("conv_id"), "role", turn.cast("long").alias("turn"), ident(turn).alias("call_id"), tool.alias("tool"), args.alias("arguments"), after.alias("after")
    )
    results = turns.where(F.col("role") == "assistant").select(ident(turn - 1).alias("call_id"), text.alias("content"))
    return calls, results


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*calls_of_turns(table(spark, sf_dir, "conversations")))


SQL = """
WITH RECURSIVE u AS (
  SELECT conv_id, turn, role, concat(coalesce(conv_id::VARCHAR, 'null'), ':', turn) AS id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, turn // 2 AS k,
    concat(coalesce(conv_id::VARCHAR, 'null'), ':', 2 * ((turn // 2) & (turn // 2 - 1)) + turn % 2) AS dep FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
 c AS (SELECT *, CASE k % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE 'count' END AS tool, CASE WHEN n % 7 = 0 THEN concat('"', n % 50, '"') ELSE (n % 50)::VARCHAR END AS lim, to_json(t)::VARCHAR AS j,
    CASE WHEN k > 0 AND dep IN (SELECT id FROM u) THEN dep END AS on_ FROM u),
 lv AS (SELECT id, 0 AS level FROM c WHERE on_ IS NULL UNION ALL SELECT c.id, level + 1 FROM c JOIN lv ON c.on_ = lv.id),
 r AS (SELECT concat(coalesce(conv_id::VARCHAR, 'null'), ':', turn - 1) AS id, min(coalesce(text, '')) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1),
 x AS (SELECT c.*, level, r.id IS NOT NULL AS linked, content,
    CASE WHEN tool <> 'translate' AND n % 7 = 0 THEN 'limit: not BIGINT' WHEN tool = 'translate' AND n % 5 = 0 THEN 'to: missing' ELSE '' END AS problems,
    CASE tool WHEN 'search' THEN concat('{"limit":', lim, ',"query":', j, '}') WHEN 'count' THEN concat('{"limit":', lim, ',"text":', j, '}') ELSE concat('{"text":', j, CASE WHEN n % 5 = 0 THEN '' ELSE ',"to":"en"' END, '}') END AS args
  FROM c JOIN lv USING (id) LEFT JOIN r ON r.id = c.id)
SELECT conv_id, turn, role, id AS call_id, tool, level::INTEGER AS level, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) - 1 AS place, linked, problems = '' AS valid, problems,
  concat('{"arguments":', args, ',"id":"', id, '","result":', coalesce(to_json(content)::VARCHAR, 'null'), ',"tool":"', tool, '"}') AS call_json FROM x
"""
