"""Queries of text functions and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators import planning, structure
from ragspark.sources.files import rows_to_markdown as to_markdown

from .tables import LINES, lines, messages, query, table

_RESPONSE = """concat(CASE WHEN item_id % 2 = 0 THEN concat('```json', chr(10)) ELSE '' END, '{"queryType":"',
 CASE item_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'direct' WHEN 2 THEN 'contextual_rewrite' WHEN 3 THEN 'decomposition' ELSE 'hyde' END, '","queries":["', replace(substr(text, 1, 60), chr(10), ' '), '"',
 CASE WHEN item_id % 5 = 3 THEN concat(',"', replace(substr(text, 20, 40), chr(10), ' '), '"', CASE WHEN item_id % 3 = 0 THEN concat(',"', lower(replace(substr(text, 20, 40), chr(10), ' ')), '"') ELSE '' END) ELSE '' END, ']}',
 CASE WHEN item_id % 2 = 0 THEN concat(chr(10), '```') ELSE '' END)"""
_ANSWERS_SQL = f"resp AS (SELECT item_id AS case_id, text AS question, {_RESPONSE} AS response FROM benchmark)"


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers of a router, made of the benchmark's texts; a fifth has a type that doesn't exist."""
    return table(spark, d, "benchmark").selectExpr("item_id AS case_id", "text AS question", f"{_RESPONSE} AS response")


_JSON = "json AS (SELECT *, trim(replace(replace(response, '```json', ''), '```', ''), ' ' || chr(10)) AS j FROM resp), p AS (SELECT *, j->>'$.queryType' AS kind, list_transform(CAST(j->'$.queries' AS VARCHAR[]), lambda x: trim(x)) AS qs FROM json)"


@query(f"WITH {_ANSWERS_SQL}, {_JSON} SELECT case_id, kind, array_to_string(qs, '|') AS queries FROM p")
def parse_model_json(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).select("case_id", planning.parse_decision(F.col("response")).alias("d"))
    return a.select("case_id", F.col("d.queryType").alias("kind"), F.array_join(F.transform("d.queries", T.trimmed), "|").alias("queries"))


@query(
    f"""WITH {_ANSWERS_SQL}, {_JSON}, c AS (SELECT *, list_filter(qs, lambda x, i: x <> '' AND list_position(list_transform(qs, lambda y: lower(y)), lower(x)) = i) AS dq FROM p),
 e AS (SELECT *, CASE WHEN kind NOT IN ('none', 'direct', 'contextual_rewrite', 'decomposition') THEN 'unknown type' WHEN kind = 'contextual_rewrite' AND len(dq) <> 1 THEN 'a rewrite needs one query'
  WHEN kind = 'decomposition' AND len(dq) < 2 THEN 'a decomposition needs two queries' END AS error FROM c),
 t AS (SELECT *, CASE WHEN error IS NULL THEN kind ELSE 'direct' END AS query_type, trim(question, ' ' || chr(10)) AS q FROM e)
 SELECT case_id, query_type, error IS NOT NULL AS fallback, error, CASE query_type WHEN 'none' THEN '' WHEN 'direct' THEN q ELSE concat_ws('|', q, nullif(array_to_string(list_filter(dq, lambda x: lower(x) <> lower(q)), '|'), '')) END AS queries FROM t"""
)
def query_plan(spark: SparkSession, d: str) -> DataFrame:
    p = planning.query_plan(answers(spark, d))
    return p.select("case_id", "query_type", "fallback", "error", F.array_join("queries", "|").alias("queries"))


@query("WITH t AS (SELECT conv_id, turn, role, trim(CASE WHEN length(text) > 300 THEN concat(substr(text, 1, 300), '…') ELSE text END, ' ' || chr(10)) AS content FROM conversations WHERE role IN ('user', 'assistant')) SELECT * FROM t WHERE content <> ''")
def router_history(spark: SparkSession, d: str) -> DataFrame:
    m = planning.router_history(messages(spark, d))
    return m.select(F.col("session_id").alias("conv_id"), "turn", "role", "content")


@query("SELECT doc_id, (length(text) // 2 + 1)::INTEGER AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, greatest(1, (('0x' || substr(sha256(concat(doc_id, ':0', chr(10), text)), 1, 16))::UBIGINT & 9223372036854775807)::BIGINT) AS chunk_id FROM documents")
def chunk_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.chunk_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, sha256(CASE WHEN trim(source) = '' THEN text ELSE concat(source, chr(10), text) END) AS digest FROM documents")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.embed_text(F.col("source"), F.col("text")), 256).alias("digest"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 30 THEN concat(substr(text, 1, 30), '…') ELSE text END AS short, CASE WHEN length(t) > 80 THEN concat(substr(t, 1, 80), '…') ELSE t END AS one_line FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) x")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.truncated(t, 30).alias("short"), T.compact(t, 80).alias("one_line"))


@query(r"SELECT page_id, length(regexp_replace(html, '\s', '', 'g')) < 8 OR (length(html) - length(regexp_replace(html, '[\x{FFFD}\x{E000}-\x{F8FF}]', '', 'g'))) / greatest(length(regexp_replace(html, '\s', '', 'g')), 1) >= 0.3 AS garbled, length(regexp_replace(html, '\s', '', 'g')) AS visible FROM pages")
def garbled_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", T.garbled(F.col("html")).alias("garbled"), T.visible(F.col("html")).cast("long").alias("visible"))


@query(
    """WITH x AS (SELECT source, length(text) AS total, length(text) - length(replace(text, '#', '')) AS invalid FROM documents)
 SELECT source, sum(invalid)::BIGINT AS invalid, sum(total)::BIGINT AS total, sum(invalid) >= 3 AND sum(invalid) * 100 >= sum(total) AS poor FROM x GROUP BY 1"""
)
def poor_text_docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a source are its atoms; a # counts as invalid here, as the tables hold nothing that does."""
    a = table(spark, d, "documents").select(F.col("source").alias("document_id"), "text")
    out = structure.poor_text_docs(a, F.length("text") - F.length(F.replace("text", F.lit("#"), F.lit(""))), F.length("text"))
    return out.select(F.col("document_id").alias("source"), "invalid", "total", "poor")


@query("SELECT c_custkey, CASE WHEN trim(c_name) = '' THEN '' WHEN length(c_name) <= 4 THEN '****' ELSE concat('****', right(c_name, 4)) END AS masked FROM customer")
def mask_secret(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.masked(F.col("c_name")).alias("masked"))


@query(
    """WITH x AS (SELECT c_custkey, lower(concat(replace(c_name, '#', ''), CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '@Example.com' END)) AS v FROM customer), e AS (SELECT c_custkey, CASE WHEN contains(v, '@') THEN v END AS email FROM x)
 SELECT c_custkey, email, coalesce(nullif(substr(split_part(email, '@', 1), 1, 64), ''), 'user') AS nickname FROM e"""
)
def normalize_email(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    raw = F.concat(F.lit("  "), F.upper(F.replace("c_name", F.lit("#"), F.lit(""))), F.when(F.col("c_custkey") % 9 == 0, "").otherwise("@Example.com"), F.lit(" "))
    out = c.select("c_custkey", T.normal_email(raw).alias("email"))
    return out.withColumn("nickname", T.nickname(F.col("email")))


_QA_LINES = f"""{LINES}, ql AS (SELECT document_id, line_no, CASE line_no % 4 WHEN 0 THEN concat('Q: ', line) WHEN 1 THEN concat('A: ', line) ELSE line END AS line FROM lines)"""


def _qa_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, every fourth labelled as a question and the next as an answer."""
    n = F.col("line_no") % 4
    return lines(spark, d).select("document_id", "line_no", F.when(n == 0, F.concat(F.lit("Q: "), "line")).when(n == 1, F.concat(F.lit("A: "), "line")).otherwise(F.col("line")).alias("line"))


_STRIP = r"""trim(regexp_replace(trim(line, ' ' || chr(10) || chr(9)), '(?i)^\s*(?:问题|答案|回答|问|答|q|a|question|answer)\s*[:：\t ]+', ''), ' ' || chr(10) || chr(9))"""


@query(f"WITH {_QA_LINES} SELECT document_id, line_no, {_STRIP} AS field FROM ql")
def clean_qa(spark: SparkSession, d: str) -> DataFrame:
    return _qa_lines(spark, d).select("document_id", F.col("line_no").cast("long").alias("line_no"), T.clean_qa(F.col("line")).alias("field"))


@query(
    rf"""WITH {_QA_LINES}, t AS (SELECT document_id, line_no, trim(line, ' ' || chr(9) || chr(13)) AS line FROM ql), nb AS (SELECT * FROM t WHERE line <> ''),
 q AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^\s*(?:q|question)\s*[:：]\s*(.+)$') THEN regexp_extract(line, '(?i)^\s*(?:q|question)\s*[:：]\s*(.+)$', 1)
  WHEN regexp_matches(line, '^\s*(?:[0-9]{{1,4}}[.、）)]|[-*•])\s*(.+)$') THEN regexp_extract(line, '^\s*(?:[0-9]{{1,4}}[.、）)]|[-*•])\s*(.+)$', 1) WHEN regexp_matches(line, '[?？]$') THEN line END AS q FROM nb),
 p AS (SELECT *, sum((q IS NOT NULL)::INTEGER) OVER (PARTITION BY document_id ORDER BY line_no) AS pair_no FROM q),
 a AS (SELECT document_id, pair_no, line_no, q, CASE WHEN q IS NULL THEN nullif(CASE WHEN regexp_matches(line, '(?i)^\s*(?:a|answer)\s*[:：]\s*(.*)$') THEN regexp_extract(line, '(?i)^\s*(?:a|answer)\s*[:：]\s*(.*)$', 1) ELSE line END, '') END AS a FROM p WHERE pair_no > 0),
 g AS (SELECT document_id, pair_no, max(q) AS question, string_agg(a, chr(10) ORDER BY line_no) AS answer FROM a GROUP BY 1, 2)
 SELECT document_id, pair_no::BIGINT AS pair_no, question, trim(answer, ' ' || chr(10) || chr(9)) AS answer FROM g WHERE trim(question) <> '' AND answer <> ''"""
)
def qa_question_lines(spark: SparkSession, d: str) -> DataFrame:
    return structure.qa_question_lines(_qa_lines(spark, d)).select("document_id", F.col("pair_no").cast("long").alias("pair_no"), "question", "answer")


_HEADED = "hl AS (SELECT document_id, line_no, CASE line_no % 10 WHEN 0 THEN concat(substr('###', 1, (line_no % 3 + 1)::INTEGER), ' ', line) WHEN 5 THEN concat(line_no, '.', line_no % 7, ' ', substr(line, 1, 40)) ELSE line END AS line FROM lines)"


@query(
    rf"""WITH {LINES}, {_HEADED}, t AS (SELECT document_id, line_no, trim(line, ' ' || chr(9) || chr(13)) AS line FROM hl)
 SELECT document_id, line_no, CASE WHEN regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*$') THEN length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 1)) WHEN length(line) > 100 THEN NULL
  WHEN regexp_matches(line, '(?i)^(?:[1-9]\d*(?:\.\d+)*[\s　.、]+.{{1,80}}|(?:abstract|introduction|related\s+works?|methods?|methodology|experiments?|results?|discussion|conclusions?|references|acknowledg(?:e)?ments?)[\s　:：]*)$')
  THEN CASE WHEN regexp_matches(regexp_extract(line, '^(\S+)', 1), '^\d+(\.\d+)*[.、]*$') THEN least(6, len(string_split(regexp_replace(regexp_extract(line, '^(\S+)', 1), '[.、]+$', ''), '.'))) ELSE 1 END END::INTEGER AS level FROM t"""
)
def heading_level(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("line_no")
    marked = F.when(n % 10 == 0, F.concat(F.repeat(F.lit("#"), n % 3 + 1), F.lit(" "), "line")).when(n % 10 == 5, F.concat(n.cast("string"), F.lit("."), (n % 7).cast("string"), F.lit(" "), F.substring("line", 1, 40))).otherwise(F.col("line"))
    h = lines(spark, d).select("document_id", n.cast("long").alias("line_no"), T.heading(marked, "paper").alias("h"))
    return h.select("document_id", "line_no", F.col("h.level").alias("level"))


_RESUME = f"""raw AS (SELECT doc_id, i, trim(regexp_replace(trim(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[i]), '^#{{1,6}}\\s*', '')) AS line FROM documents, unnest(range(1, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) + 1)) AS t(i)),
 l AS (SELECT *, CASE {" ".join(f"WHEN lower(trim(regexp_replace(line, '[ :：]+$', ''))) IN ({', '.join(repr(n) for n in names)}) THEN '{k}'" for k, names in structure.SECTIONS.items())} END AS kind FROM raw WHERE line <> ''),
 told AS (SELECT doc_id, i, line, kind, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '{structure.BASIC}') AS section FROM l)"""


@query(
    rf"""WITH {_RESUME}, t AS (SELECT * FROM told WHERE kind IS NULL),
 f AS (SELECT doc_id, arg_min(line, i) FILTER (section = '{structure.BASIC}' AND regexp_matches(line, '^[\p{{L}} ·]{{1,16}}$')) AS name, arg_min(regexp_extract(line, '{structure._PHONE}'), i) FILTER (regexp_matches(line, '{structure._PHONE}')) AS phone,
  arg_min(regexp_extract(line, '{structure._EMAIL}'), i) FILTER (regexp_matches(line, '{structure._EMAIL}')) AS email FROM t GROUP BY 1)
 SELECT doc_id, name, phone, email FROM documents LEFT JOIN f USING (doc_id)"""
)
def contact_entities(spark: SparkSession, d: str) -> DataFrame:
    return structure.contact_entities(lines(spark, d)).select(F.col("document_id").alias("doc_id"), "name", "phone", "email")


@query("WITH c AS (SELECT n_nationkey, list_filter([CASE WHEN n_nationkey % 2 = 0 THEN ' ' ELSE n_nationkey::VARCHAR END, trim(n_name), n_regionkey::VARCHAR], lambda x: trim(x) <> '') AS c FROM nation) SELECT n_nationkey, c[1] AS question, c[2] AS answer FROM c WHERE len(c) >= 2")
def qa_table_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    cells = F.array(F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise(F.col("n_nationkey").cast("string")), F.col("n_name"), F.col("n_regionkey").cast("string"))
    return structure.qa_table_rows(n.select("n_nationkey", cells.alias("cells")))


_NAMES = "concat(source, '.', CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'MD' WHEN 2 THEN 'txt' WHEN 3 THEN 'csv' WHEN 4 THEN 'jpeg' ELSE 'bin' END)"


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'text/csv' WHEN 4 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS media, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'text' WHEN 3 THEN 'csv' WHEN 4 THEN 'image' ELSE 'unsupported' END AS preview, {_NAMES} AS name FROM documents")
def media_type(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", F.expr(_NAMES).alias("name"))
    return n.select("doc_id", T.media_type(F.col("name")).alias("media"), T.preview_kind(F.col("name")).alias("preview"), "name")


@query(f"WITH {LINES}, t AS (SELECT document_id, line_no, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines), x AS (SELECT *, lag(line) OVER (PARTITION BY document_id ORDER BY line_no) AS b FROM t WHERE line <> '') SELECT document_id, line_no, line FROM x WHERE b IS NULL OR b <> line")
def compact_lines(spark: SparkSession, d: str) -> DataFrame:
    return structure.compact_lines(lines(spark, d)).select("document_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(
    f"""WITH {LINES}, t AS (SELECT source, document_id AS page, line_no, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
 e AS (SELECT source, page, arg_min(line, line_no) AS first, arg_max(line, line_no) AS last, min(line_no) AS lo, max(line_no) AS hi FROM t GROUP BY 1, 2), n AS (SELECT source, count(*) AS pages FROM e GROUP BY 1),
 ends AS (SELECT source, 'first' AS e, first AS line FROM e UNION ALL SELECT source, 'last', last FROM e),
 often AS (SELECT source, e, line FROM (SELECT source, e, line, count(*) AS n FROM ends WHERE length(line) < 40 GROUP BY 1, 2, 3) x JOIN n USING (source) WHERE pages >= 2 AND x.n >= 2 AND 2 * x.n >= pages),
 gone AS (SELECT e.source, page, lo AS line_no FROM e JOIN often o ON o.source = e.source AND o.e = 'first' AND o.line = e.first UNION SELECT e.source, page, hi FROM e JOIN often o ON o.source = e.source AND o.e = 'last' AND o.line = e.last)
 SELECT source, document_id AS page, count(*) AS lines FROM lines l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.source = l.source AND g.page = l.document_id AND g.line_no = l.line_no) GROUP BY 1, 2"""
)
def strip_running_lines(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a source are its pages."""
    pages = lines(spark, d).select(F.col("source").alias("document_id"), F.col("document_id").alias("page"), "line_no", "line")
    out = structure.strip_running_lines(pages)
    return out.groupBy(F.col("document_id").alias("source"), "page").agg(F.count(F.lit(1)).alias("lines"))


_DELIMITED = "string_agg(concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ',' ELSE chr(9) END, p_type), chr(10) ORDER BY p_partkey)"


@query(
    f"""WITH x AS (SELECT p_size AS document_id, {_DELIMITED} AS text FROM part GROUP BY 1)
 SELECT document_id, CASE WHEN len(list_filter(string_split(text, chr(10)), lambda l: len(string_split(l, chr(9))) = 2)) >= len(list_filter(string_split(text, chr(10)), lambda l: len(string_split(l, ',')) = 2)) THEN chr(9) ELSE ',' END AS delimiter FROM x"""
)
def detect_delimiter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("line", F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ",").otherwise("\t"), "p_type"))
    return structure.detect_delimiter(p.groupBy(F.col("p_size").alias("document_id")).agg(structure.joined("line", "p_partkey").alias("text")))


@query(f"WITH {LINES} SELECT document_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY line_no)) AS digest FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1")
def document_text(spark: SparkSession, d: str) -> DataFrame:
    atoms = lines(spark, d).select("document_id", F.col("line_no").alias("atom_index"), F.col("line").alias("text"))
    return structure.document_text(atoms).select("document_id", F.md5("text").alias("digest"))


@query(
    """WITH p AS (SELECT source AS document_id, doc_id AS page, text, doc_id % 7 = 0 AS is_image, sum((doc_id % 7 = 0)::INTEGER) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM documents)
 SELECT document_id, min(page) AS page, max(page) AS last_page, is_image, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS digest FROM p GROUP BY document_id, run, is_image"""
)
def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a source are its pages, every seventh an image."""
    p = table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), "text", (F.col("doc_id") % 7 == 0).alias("is_image"))
    return structure.merge_pages(p).select("document_id", "page", "last_page", "is_image", F.md5("text").alias("digest"))


@query(
    """WITH l AS (SELECT p_partkey AS k, p_partkey // 256 AS block_no, concat('| ', p_partkey, ' | ', replace(p_name, '|', '\\|'), ' | ', replace(p_brand, '|', '\\|'), ' |') AS l FROM part)
 SELECT block_no, md5(concat('## part (', min(k), '-', max(k), ')', chr(10), chr(10), '| p_partkey | p_name | p_brand |', chr(10), '| --- | --- | --- |', chr(10), string_agg(l, chr(10) ORDER BY k))) AS digest FROM l GROUP BY 1"""
)
def rows_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return to_markdown(table(spark, d, "part"), "part", "p_partkey", ["p_partkey", "p_name", "p_brand"]).select("block_no", F.md5("content").alias("digest"))


@query(
    r"""WITH s AS (SELECT doc_id, regexp_replace(text, '(\p{L}{6})(\p{Ll}{6,})', '\1-' || chr(10) || '\2', 'g') AS t FROM documents), gone AS (SELECT doc_id, regexp_replace(t, '(\p{Ll})-\n(\p{Ll}+(?:\s|$))', '\1\2', 'g') AS t FROM s)
 SELECT doc_id, regexp_replace(t, '(\p{L})-\n(\p{L})', '\1-\2', 'g') AS text FROM gone"""
)
def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose words over 12 letters are split by a hyphen at a line's end, joined again."""
    t = table(spark, d, "documents").select("doc_id", F.split(F.regexp_replace("text", r"(\p{L}{6})(\p{Ll}{6,})", "$1-\n$2"), "\n").alias("lines"))
    return t.select("doc_id", F.array_join(structure.dehyphenate(F.col("lines")), "\n").alias("text"))
