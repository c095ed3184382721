"""Queries of sources and sinks, over inputs derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.operators import structure
from ragspark.sources import files, goldset, qa, sinks

from .tables import DOCS, LINES, chunks, lines, query, table
from .texts import _RESUME, _STRIP


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def decode_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts as bytes, by doc_id in UTF-8, UTF-8 with a mark, or UTF-16 of either order, decoded again."""
    k = F.col("doc_id") % 4
    utf8 = F.encode("text", "UTF-8")
    raw = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(k == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).otherwise(utf8)
    return files.decode_text(table(spark, d, "documents").select("doc_id", raw.alias("content"))).select("doc_id", F.md5("text").alias("digest"))


@query(
    """SELECT item_id AS id, array_to_string(list_sort(list_filter([CASE WHEN item_id % 5 = 1 THEN 'unknown route' END, CASE WHEN item_id % 7 = 1 THEN 'no dataset' END, CASE WHEN item_id % 3 = 1 THEN 'no evidence declared' END,
 CASE WHEN item_id % 3 = 2 AND item_id % 2 = 0 THEN 'contradictory evidence' END, CASE WHEN item_id % 11 = 1 THEN 'bad history role' END, CASE WHEN item_id % 3 <> 1 AND item_id % 13 = 1 THEN 'empty marker' END], lambda x: x IS NOT NULL)), ',') AS errors FROM benchmark"""
)
def validate_cases(spark: SparkSession, d: str) -> DataFrame:
    """Gold cases made of the benchmark, with mistakes by item_id."""
    k = F.col("item_id")
    marker = F.when(k % 13 == 1, F.lit(" ")).otherwise(F.lit("a"))
    evidence = F.when(k % 3 == 1, F.expr("array()").cast("array<struct<documentName:string,contains:array<string>>>")).otherwise(F.array(F.struct(F.lit("d").alias("documentName"), F.array(marker).alias("contains"))))
    case = F.struct(
        k.cast("string").alias("id"), F.when(k % 7 == 1, 0).otherwise(1).alias("datasetId"), F.array(F.struct(F.when(k % 11 == 1, "system").otherwise("user").alias("role"), F.lit("x").alias("content"))).alias("history"),
        F.col("text").alias("question"), F.when(k % 5 == 1, "hyde").otherwise("direct").alias("expectedRoute"), evidence.alias("relevantEvidence"), ((k % 3 == 2) & (k % 2 == 0)).alias("expectNoEvidence"),
    )
    out = goldset.parse_cases(table(spark, d, "benchmark").select(F.to_json(case).alias("value")))
    return out.select(F.col("id").cast("long").alias("id"), F.array_join("errors", ",").alias("errors"))


@query(
    f"""WITH {LINES} SELECT document_id, line_no AS atom_index, CASE WHEN line_no % 4 = 1 THEN concat('## ', trim(line, ' ' || chr(9) || chr(13))) ELSE trim(line, ' ' || chr(9) || chr(13)) END AS text, line_no // 40 + 1 AS page
 FROM lines WHERE line_no % 4 <> 2 AND trim(line, ' ' || chr(9) || chr(13)) <> ''"""
)
def layout_json_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Lines as items of a layout: text, titles, page headers (left out) and other."""
    n = F.col("line_no")
    kind = F.when(n % 4 == 1, "title").when(n % 4 == 2, "header").when(n % 4 == 3, "equation").otherwise("text")
    item = F.struct(kind.alias("type"), F.col("line").alias("text"), F.when(n % 4 == 1, 2).otherwise(0).alias("text_level"), F.floor(n / 40).cast("int").alias("page_idx"))
    docs = lines(spark, d).groupBy("document_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("o"), item.alias("i")))), lambda x: x["i"])).alias("json"))
    return files.layout_json_atoms(docs).select("document_id", F.col("atom_index").cast("long").alias("atom_index"), "text", F.col("page").cast("long").alias("page"))


@query(f"WITH {DOCS}, x AS (SELECT document_id AS chunk_id, CASE WHEN document_id % 4 = 0 THEN concat('edited ', document_id) ELSE content END AS content FROM docs) SELECT chunk_id, md5(content) AS digest, length(content) // 2 + 1 AS token_num FROM x")
def apply_chunk_edits(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth chunk has a new text, the others a blank edit."""
    old = chunks(spark, d).withColumn("token_num", F.floor(F.length("content") / 2) + 1)
    edits = old.select("chunk_id", F.when(F.col("chunk_id") % 4 == 0, F.concat(F.lit("  edited "), F.col("chunk_id").cast("string"))).otherwise(" ").alias("content"))
    return sinks.apply_chunk_edits(old, edits)[0].select("chunk_id", F.md5("content").alias("digest"), F.col("token_num").cast("long").alias("token_num"))


@query(f"WITH {DOCS} SELECT dataset_id, count(*) AS chunks, sum(CASE WHEN document_id % 5 = 0 THEN 0 ELSE length(content) END)::BIGINT AS chars FROM docs GROUP BY 1")
def replace_document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth document gets one empty chunk instead of its own."""
    old = chunks(spark, d)
    new = old.where("document_id % 5 = 0").withColumn("content", F.lit(""))
    out = sinks.replaced(old, new, new.select("document_id"))
    return out.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 9 = 0 THEN 0 ELSE len(embedding) END::INTEGER AS dim, vec_id % 9 <> 0 AS kept FROM embeddings")
def write_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with their dimension; every ninth is empty and rejected."""
    none = F.expr("cast(array() as array<float>)")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 9 == 0, none).otherwise(F.col("embedding")).alias("embedding"))
    good, bad = sinks.checked_vectors(v)
    return good.select("chunk_id", "dim", F.lit(True).alias("kept")).unionByName(bad.select("chunk_id", "dim", F.lit(False).alias("kept")))


@query(
    rf"""WITH x AS (SELECT p_size AS document_id, p_partkey, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ',' ELSE chr(9) END, p_type) AS line FROM part),
 d AS (SELECT document_id, CASE WHEN count(*) FILTER (len(string_split(line, chr(9))) = 2) >= count(*) FILTER (len(string_split(line, ',')) = 2) THEN chr(9) ELSE ',' END AS d FROM x GROUP BY 1),
 r AS (SELECT *, string_split(line, d) AS f FROM x JOIN d USING (document_id)), n AS (SELECT *, sum((len(f) = 2)::INTEGER) OVER (PARTITION BY document_id ORDER BY p_partkey) AS pair_no FROM r),
 a AS (SELECT document_id, pair_no, arg_min(f[1], p_partkey) AS q, string_agg(CASE WHEN len(f) = 2 THEN f[2] ELSE trim(line) END, chr(10) ORDER BY p_partkey) AS a FROM n WHERE pair_no > 0 GROUP BY 1, 2),
 c AS (SELECT document_id, pair_no, {_STRIP.replace("line", "q")} AS question, {_STRIP.replace("line", "a")} AS answer FROM a)
 SELECT document_id::BIGINT AS document_id, pair_no::BIGINT AS pair_no, question, answer FROM c WHERE question <> '' AND answer <> ''"""
)
def qa_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Names and types of parts as two columns, a document for each size, some lines with a comma for the tab."""
    p = table(spark, d, "part").withColumn("line", F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ",").otherwise("\t"), "p_type"))
    return qa.qa_delimited(p.groupBy(F.col("p_size").cast("long").alias("document_id")).agg(structure.joined("line", "p_partkey").alias("text")))


@query(
    f"""WITH {LINES}, c AS (SELECT document_id, line_no, line, CASE WHEN line_no < 2 THEN 'basic' WHEN line_no = 2 THEN 'project' ELSE 'other' END AS type FROM lines WHERE line_no <= 2 OR trim(line, ' ' || chr(9) || chr(13)) <> ''),
 g AS (SELECT document_id, type, CASE WHEN type = 'project' THEN 'P' ELSE coalesce(arg_min(line, line_no) FILTER (length(line) <= 36), '') END AS title, string_agg(line, chr(10) ORDER BY line_no) AS text, min(line_no) AS lo FROM c GROUP BY 1, 2)
 SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY lo) - 1)::INTEGER AS group_no, type, title, text FROM g"""
)
def claim_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two groups claim the first lines of every document, both the second."""
    answer = '[{"type":"basic","title":"","lines":[0,1,1000000]},{"type":"project","title":"P","lines":[1,2]}]'
    picked = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(answer).alias("response"))
    return structure.claim_lines(lines(spark, d), picked)


@query(
    rf"""WITH {_RESUME}, f AS (SELECT doc_id, arg_min(line, i) FILTER (regexp_matches(line, '^[\p{{L}} ·]{{1,16}}$')) AS name, arg_min(regexp_extract(line, '{structure._EMAIL}'), i) FILTER (regexp_matches(line, '{structure._EMAIL}')) AS email FROM told WHERE kind IS NULL GROUP BY 1)
 SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 1 AND contains(text, 'Nobody') THEN 'Nobody' ELSE name END AS name, email FROM documents LEFT JOIN f USING (doc_id)"""
)
def verify_entities(spark: SparkSession, d: str) -> DataFrame:
    """Contacts found by rule, with what a model might have made of them."""
    ruled = structure.contact_entities(lines(spark, d), everywhere=True)
    given = ruled.select("document_id", F.when(F.col("document_id") % 2 == 0, F.col("name")).otherwise("Nobody").alias("name"), F.col("email"))
    return structure.verify_entities(given, table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), ruled, ["name", "email"])


@query(
    f"""WITH {LINES} SELECT document_id, (line_no // 24 + 1)::BIGINT AS table_no, (2 * line_no + k)::BIGINT AS line_no, CASE WHEN line_no % 48 = 24 THEN '-|-' ELSE concat(line_no, '|', trim(replace(line, '|', '/'), ' ' || chr(9) || chr(13))) END AS cells, line_no % 24 = 0 AS is_header
 FROM lines, (VALUES (0), (1)) AS v(k) WHERE line_no % 24 <> 23 AND (k = 0 OR line_no % 8 <> 0)"""
)
def pipe_tables(spark: SparkSession, d: str) -> DataFrame:
    """Lines with pipes, a separator after every eighth, spaced or not; every 24th line ends a table, and every other header is a separator itself."""
    n = F.col("line_no")
    row = F.concat(F.lit("| "), F.col("line_no").cast("string"), F.lit(" | "), F.replace("line", F.lit("|"), F.lit("/")), F.lit(" |"))
    row = F.when(n % 24 == 23, F.lit("no row")).when(n % 48 == 24, F.lit("-|-")).otherwise(row)
    below = F.when(n % 16 == 0, "|- - -|: - :|").when(n % 8 == 0, "---|:-:").when(n % 24 == 23, "").when(n % 48 == 24, F.lit("|x|y|")).otherwise(row)
    two = lines(spark, d).select("document_id", F.explode(F.array(F.struct((n * 2).alias("line_no"), row.alias("line")), F.struct((n * 2 + 1).alias("line_no"), below.alias("line")))).alias("x"))
    t = structure.pipe_tables(two.select("document_id", "x.line_no", "x.line"))
    return t.select("document_id", "table_no", F.col("line_no").cast("long").alias("line_no"), F.array_join("cells", "|").alias("cells"), "is_header")


@query(
    rf"""WITH t AS (SELECT page_id, replace(html, '</h1>', '</h1>![p](data:image/png;base64,AA)') AS s FROM pages), x AS (SELECT page_id, regexp_split_to_array(s, '{structure._IMAGE}') AS g, regexp_extract_all(s, '{structure._IMAGE}') AS m FROM t),
 u AS (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM x), v AS (SELECT page_id, 2 * i AS k, 'text' AS element_type, trim(g[i], ' ' || chr(9) || chr(10) || chr(13)) AS text FROM u UNION ALL SELECT page_id, 2 * i + 1, 'image', m[i] FROM u)
 SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS part_no, element_type, text, element_type = 'image' AND contains(lower(text), 'data:image') AS is_data FROM v WHERE text <> ''"""
)
def inline_images(spark: SparkSession, d: str) -> DataFrame:
    """Pages' sources with a picture put after each heading."""
    p = table(spark, d, "pages").select("page_id", F.replace("html", F.lit("</h1>"), F.lit("</h1>![p](data:image/png;base64,AA)")).alias("text"))
    return structure.inline_images(p)
