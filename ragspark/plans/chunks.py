"""Queries of chunking, from texts and from atoms, with the splitter as a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators import atoms as A
from ragspark.operators import chunking, structure
from ragspark.sources import files

from .tables import DOCS, LINES, documents, lines, query, table
from .texts import _RESUME, _STRIP

#: white space in SQL
_W = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"


def _split(source: str, name: str, target: int = chunking.TARGET, overlap: int = chunking.OVERLAP) -> str:
    """CTEs up to ``name``(key, piece_index, piece): the splitter over ``source``(key, text).

    A step takes the last of a list of things to do: a text with its separator (none: a chunk), the place to go on from and
    the number of chunks before it.
    """
    separators = ", ".join(f"'{s}'" if s.isprintable() else " || ".join("chr(10)" for _ in s) for s in chunking.SEPARATORS)
    return f"""{name}_s AS (SELECT key, [{{'t': trim(text, {_W}), 'l': CASE WHEN length(trim(text, {_W})) > {target} THEN 0 END, 'a': 0::BIGINT, 'b': 0::BIGINT}}] AS todo, []::VARCHAR[] AS done FROM {source}
 UNION ALL SELECT key, CASE WHEN l IS NULL OR a >= length(t) THEN rest ELSE rest || [{{'t': t, 'l': l, 'a': e, 'b': b}}, {{'t': p, 'l': CASE WHEN length(p) > {target} AND l < {len(chunking.SEPARATORS) - 1} THEN l + 1 END, 'a': 0, 'b': len(done)}}] END,
  CASE WHEN l IS NULL AND t <> '' THEN done || [t] ELSE done END
 FROM (SELECT *, trim(tail || substr(t, a + 1, e - a), {_W}) AS p FROM (SELECT *, CASE WHEN l IS NULL THEN 0 WHEN length(t) - a <= room THEN length(t) WHEN sep = '' THEN least(a + {target}, length(t))
   WHEN contains(near, sep) THEN a + length(near) - length(string_split(near, sep)[-1]) WHEN contains(substr(t, a + 1), sep) THEN a + instr(substr(t, a + 1), sep) + length(sep) - 1 ELSE length(t) END AS e
  FROM (SELECT *, substr(t, a + 1, room) AS near FROM (SELECT *, {target} - length(tail) AS room, [{separators}][l + 1] AS sep FROM (SELECT key, rest, done, x.t AS t, x.l AS l, x.a AS a, x.b AS b, CASE WHEN len(done) > x.b THEN right(done[-1], {overlap}) ELSE '' END AS tail
   FROM (SELECT key, todo[:-2] AS rest, todo[-1] AS x, done FROM {name}_s WHERE len(todo) > 0))))))),
 {name} AS (SELECT key, unnest(range(0, len(done))) AS piece_index, unnest(done) AS piece FROM {name}_s WHERE len(todo) = 0)"""


@query(f"WITH RECURSIVE src AS (SELECT doc_id AS key, text FROM documents), {_split('src', 'pieces')} SELECT key AS document_id, piece_index::INTEGER AS piece_index, piece FROM pieces")
def chunk_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The recursive splitter over all texts."""
    return chunking.split_recursive(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"))


# ---------------------------------------------------------------- atoms

#: atoms made of lines, by line_no: headings, titles, tables, images with and without data, text that a parser placed, and
#: plain text; valid in both dialects
_ATOMS = """SELECT document_id, CAST(line_no AS BIGINT) AS atom_index,
 CASE line_no % 11 WHEN 3 THEN concat(substr('###', 1, CAST(line_no % 3 + 1 AS INTEGER)), ' T ', substr(line, 1, 30)) WHEN 4 THEN concat('Part of ', substr(line, 1, 20)) WHEN 5 THEN concat('| q | a |', chr(10), '|---|- -|', chr(10), '| ', replace(line, '|', '/'), ' | ', CAST(line_no AS VARCHAR(20)), ' |')
  WHEN 7 THEN substr(line, 1, 10) WHEN 8 THEN concat('![', substr(line, 1, 9), '](x.png)') ELSE line END AS text,
 CASE line_no % 11 WHEN 4 THEN 'title' WHEN 5 THEN 'table' WHEN 7 THEN 'image' WHEN 8 THEN 'image' WHEN 10 THEN 'code' ELSE 'text' END AS element_type,
 CAST(line_no / 40 AS INTEGER) AS page, CASE WHEN line_no % 11 IN (5, 9) THEN 'vlm' ELSE '' END AS parser_name, line_no % 11 = 5 AS is_table, CASE WHEN line_no % 11 = 4 THEN 1 ELSE 0 END AS heading_level,
 CASE WHEN line_no % 11 = 7 THEN concat(CAST(document_id AS VARCHAR(20)), '/', CAST(line_no AS VARCHAR(20)), '.png') END AS image_key, CASE WHEN line_no % 2 = 1 THEN substr(line, 1, 20) ELSE '' END AS description FROM {lines}"""
_ATOMS_SQL = f"{LINES}, atoms AS ({_ATOMS.format(lines='lines').replace('line_no / 40', 'line_no // 40')})"


def atoms(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_ATOMS.format(lines="{l}"), l=lines(spark, d))


def _told(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "document_id", "dataset_id", "chunk_index", "token_num", "element_type", "page_number", "parser_name", "image_key", F.md5("embed_text").alias("embedded"))


def _chunks(source: str) -> str:
    """Chunks of ``source``(document_id, name, o, i, content, embed, element_type, page, parser_name, image_key) in SQL."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY o, i) - 1 AS n FROM {source})
 SELECT greatest(1, (('0x' || substr(sha256(concat(document_id, ':', n, chr(10), content, image_key)), 1, 16))::UBIGINT & 9223372036854775807)::BIGINT) AS chunk_id, document_id, dataset_id, n::INTEGER AS chunk_index, (length(content) // 2 + 1)::INTEGER AS token_num, element_type,
  page::INTEGER AS page_number, parser_name, image_key, md5(concat(name, chr(10), embed)) AS embedded FROM numbered JOIN named USING (document_id)"""


_NAMED = f"{DOCS}, named AS (SELECT document_id, dataset_id, name FROM docs)"
_SEEN = f"""CASE WHEN trim(text, {_W}) = '' AND description = '' THEN '（无文字描述）' WHEN trim(text, {_W}) = '' THEN trim(description, {_W}) WHEN trim(description, {_W}) IN ('', trim(text, {_W})) THEN trim(text, {_W}) ELSE concat(trim(text, {_W}), chr(10), trim(description, {_W})) END"""


def _units(source: str) -> str:
    """CTEs ``whole`` and ``rest`` of atoms in ``source`` that are split, and then ``made``."""
    return f"""kinds AS (SELECT *, CASE WHEN image_key IS NOT NULL THEN 'image' WHEN is_table THEN 'table' WHEN element_type = 'image' THEN 'figure' WHEN boundary THEN 'section' WHEN parser_name <> '' THEN 'placed' ELSE 'plain' END AS kind FROM {source}),
 runs AS (SELECT *, sum((kind <> 'plain')::INTEGER) OVER (PARTITION BY document_id ORDER BY atom_index) AS run FROM kinds),
 u AS (SELECT document_id, min(atom_index) AS o, string_agg(text, chr(10) || chr(10) ORDER BY atom_index) AS text, '' AS head, 'text' AS element_type, 0 AS page, '' AS parser_name, '' AS image_key, FALSE AS whole FROM runs WHERE kind = 'plain' GROUP BY document_id, run
  UNION ALL SELECT document_id, atom_index, CASE kind WHEN 'image' THEN concat('[图片] ', {_SEEN}) WHEN 'figure' THEN trim(text, {_W}) ELSE text END, CASE WHEN kind = 'placed' THEN '' ELSE section_path END, element_type, page, parser_name, coalesce(image_key, ''), no_split OR kind IN ('image', 'figure', 'table') FROM runs WHERE kind <> 'plain'),
 src AS (SELECT (document_id, o) AS key, text FROM u WHERE NOT whole), {_split("src", "pieces")},
 parts AS (SELECT u.*, piece_index AS i, piece FROM u JOIN pieces ON key = (document_id, o) UNION ALL SELECT *, 0, text FROM u WHERE whole),
 made AS (SELECT *, content AS embed FROM (SELECT *, CASE WHEN head = '' OR trim(piece, {_W}) = '' THEN trim(piece, {_W}) ELSE concat(head, chr(10), chr(10), trim(piece, {_W})) END AS content FROM parts) WHERE content <> ''),
 {_chunks("made")}"""


@query(f"WITH RECURSIVE {_NAMED}, {_ATOMS_SQL}, bare AS (SELECT *, FALSE AS boundary, FALSE AS no_split, '' AS section_path FROM atoms), {_units('bare')}")
def build_chunks_general(spark: SparkSession, d: str) -> DataFrame:
    return _told(chunking.build_chunks_atoms(documents(spark, d), atoms(spark, d), "general"))


_ANY = T.MARKDOWN
_PAPER = T.PAPER.replace("(?iu)", "(?i)")
_BOOK = T.BOOK.replace("(?iu)", "(?i)")


def _path(sep: str, levels: int = 6) -> str:
    """The titles of the open headings; p1, t1, ... are place and title of the last heading of each level."""
    above = lambda k: f"greatest(-1, {', '.join(f'coalesce(p{j}, -1)' for j in range(1, k))})" if k > 1 else "-1"
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN p{k} > {above(k)} THEN t{k} END' for k in range(1, levels + 1))}], lambda x: x IS NOT NULL AND x <> ''), {sep})"


def _last(levels: int = 6) -> str:
    return ", ".join(f"last_value(CASE WHEN level = {k} THEN atom_index END IGNORE NULLS) OVER w AS p{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(1, levels + 1))


def _sections(template: str) -> str:
    """CTEs from ``atoms`` to ``sections``: text below headings, and other atoms, with their paths."""
    own = f"WHEN regexp_matches(x, '{_BOOK}') THEN CASE WHEN contains(x, '节') THEN 2 ELSE 1 END" if template == "book" else f"""WHEN regexp_matches(x, '{_PAPER}') THEN CASE WHEN regexp_matches(regexp_extract(x, '^(\\S+)', 1), '^\\d+(\\.\\d+)*[.、]*$')
  THEN least(6, len(string_split(regexp_replace(regexp_extract(x, '^(\\S+)', 1), '[.、]+$', ''), '.'))) ELSE 1 END"""
    return f"""clean AS (SELECT *, image_key IS NULL AND NOT is_table AND element_type IN ('', 'text', 'title', 'paragraph', 'section_header', 'list') AS structured, trim(trim(trim(text, {_W}), '�'), {_W}) AS x FROM atoms),
 headed AS (SELECT *, CASE WHEN NOT structured OR trim(text, {_W}) = '' THEN NULL WHEN regexp_matches(x, '{_ANY}') THEN length(regexp_extract(x, '{_ANY}', 1)) WHEN element_type = 'title' THEN 1 WHEN length(x) > 100 THEN NULL {own} END AS level,
  CASE WHEN regexp_matches(x, '{_ANY}') THEN trim(regexp_extract(x, '{_ANY}', 2), {_W}) WHEN element_type = 'title' THEN trim(ltrim(x, '# '), {_W}) ELSE x END AS title FROM clean),
 opened AS (SELECT *, {_last()}, sum((level IS NOT NULL OR NOT structured OR before <> '')::INTEGER) OVER w AS grp FROM (SELECT *, coalesce(lag(parser_name) OVER (PARTITION BY document_id ORDER BY atom_index), '') AS before FROM headed) WINDOW w AS (PARTITION BY document_id ORDER BY atom_index)),
 pathed AS (SELECT *, {_path("' / '")} AS section_path, trim(text, {_W}) AS line FROM opened),
 body AS (SELECT * FROM (SELECT *, lag(line) OVER (PARTITION BY document_id, grp ORDER BY atom_index) AS last FROM pathed WHERE structured AND level IS NULL) WHERE line <> '' OR last <> ''),
 joined AS (SELECT document_id, grp, section_path, trim(string_agg(line, chr(10) ORDER BY atom_index), {_W}) AS text, min(atom_index) FILTER (line <> '') AS atom_index, arg_min(page, atom_index) FILTER (line <> '') AS page, arg_min(parser_name, atom_index) FILTER (line <> '') AS parser_name FROM body GROUP BY 1, 2, 3),
 sections AS (SELECT document_id, atom_index, text, 'text' AS element_type, page, parser_name, FALSE AS is_table, NULL::VARCHAR AS image_key, NULL::VARCHAR AS description, section_path, TRUE AS boundary, {"lower(trim(regexp_replace(string_split(section_path, ' / ')[-1], '[ :：]+$', ''), ' ')) IN ('abstract', '摘要')" if template == "paper" else "FALSE"} AS no_split FROM joined WHERE text <> ''
  UNION ALL SELECT document_id, atom_index, text, element_type, page, parser_name, is_table, image_key, description, section_path, TRUE, FALSE FROM pathed WHERE NOT structured)"""


def _builder(template: str):  # noqa: ANN202
    return lambda spark, d: _told(chunking.build_chunks_atoms(documents(spark, d), atoms(spark, d), template))


for _t in ("book", "paper"):
    query(f"WITH RECURSIVE {_NAMED}, {_ATOMS_SQL}, {_sections(_t)}, {_units('sections')}", name=f"build_chunks_{_t}")(_builder(_t))


@query(f"WITH {_ATOMS_SQL}, {_sections('book')} SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY atom_index) - 1)::INTEGER AS section_no, section_path, md5(text) AS digest, element_type, page, parser_name FROM sections")
def section_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of books: tables, images and placed text between the sections."""
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("document_id").orderBy("atom_index")) - 1
    return A.section_atoms(atoms(spark, d), "book").select("document_id", number.alias("section_no"), "section_path", F.md5("text").alias("digest"), "element_type", "page", "parser_name")


_PLAIN_ATOMS = f"{LINES}, two AS (SELECT document_id, 2 * line_no + k AS atom_index, CASE WHEN k = 0 THEN concat(substr('###', 1, (line_no % 3 + 1)::INTEGER), ' ', substr(line, 1, 60)) ELSE line END AS text FROM lines, (VALUES (0), (1)) AS v(k) WHERE k = 1 OR line_no % 10 = 0), atoms AS (SELECT *, 'text' AS element_type, 0 AS page, '' AS parser_name, FALSE AS is_table, NULL::VARCHAR AS image_key, NULL::VARCHAR AS description FROM two)"


@query(f"WITH {_PLAIN_ATOMS}, {_sections('book')} SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY atom_index) - 1)::INTEGER AS section_no, section_path, text, no_split FROM sections")
def section_paths(spark: SparkSession, d: str) -> DataFrame:
    """Sections under headings that are put before every tenth line."""
    n = F.col("line_no")
    marked = F.when(n % 10 == 0, F.concat(F.repeat(F.lit("#"), n % 3 + 1), F.lit(" "), F.substring("line", 1, 60), F.lit("\n"), "line")).otherwise(F.col("line"))
    texts = lines(spark, d).select("document_id", "line_no", marked.alias("line")).groupBy("document_id").agg(structure.joined("line", "line_no").alias("text"))
    return structure.section_paths(structure.lines_of(texts), "book")


# ---------------------------------------------------------------- question-answer pairs

_HEADS = f"""marked AS (SELECT *, sum((starts_with(trim(text, {_W}), '```') AND NOT is_table AND NOT named)::INTEGER) OVER (PARTITION BY document_id ORDER BY atom_index) % 2 = 1 AS fenced FROM (SELECT *, NOT is_table AND element_type = 'title' AND heading_level > 0 AS named FROM qa_atoms WHERE image_key IS NULL)),
 headed AS (SELECT *, CASE WHEN named THEN heading_level WHEN NOT is_table AND NOT fenced AND regexp_matches(text, '{_ANY}') THEN length(regexp_extract(text, '{_ANY}', 1)) END AS level, trim(CASE WHEN named THEN text ELSE regexp_extract(text, '{_ANY}', 2) END, {_W}) AS title, is_table AND pairs AS apart FROM marked),
 opened AS (SELECT *, {_last()}, sum((level IS NOT NULL OR apart)::INTEGER) OVER w AS part FROM headed WINDOW w AS (PARTITION BY document_id ORDER BY atom_index)),
 pathed AS (SELECT *, {_path("chr(10)")} AS path FROM opened),
 heads AS (SELECT document_id, min(atom_index) AS o, path AS question, trim(string_agg(text, chr(10) ORDER BY atom_index), {_W}) AS answer, 0 AS page, 'qa-heading' AS parser_name FROM pathed WHERE level IS NULL AND NOT apart AND path <> '' GROUP BY document_id, part, path)"""


@query(
    f"""WITH {LINES}, qa_atoms AS (SELECT document_id, line_no AS atom_index, CASE WHEN line_no % 10 = 0 THEN concat(substr('###', 1, (line_no % 3 + 1)::INTEGER), ' ', line) ELSE line END AS text, 'text' AS element_type, FALSE AS is_table, 0 AS heading_level, NULL AS image_key, FALSE AS pairs FROM lines), {_HEADS},
 numbered AS (SELECT document_id, sum((level IS NOT NULL)::INTEGER) OVER (PARTITION BY document_id ORDER BY atom_index) AS pair_no, atom_index AS o FROM pathed)
 SELECT document_id, pair_no::BIGINT AS pair_no, question, answer FROM heads JOIN numbered USING (document_id, o) WHERE question <> '' AND answer <> ''"""
)
def qa_headings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("line_no")
    marked = lines(spark, d).withColumn("line", F.when(n % 10 == 0, F.concat(F.repeat(F.lit("#"), n % 3 + 1), F.lit(" "), "line")).otherwise(F.col("line")))
    return structure.qa_headings(marked).select("document_id", F.col("pair_no").cast("long").alias("pair_no"), "question", "answer")


_CELL = f"trim(regexp_replace(trim(text, {_W}), '^\\|[^\\n]*\\n[^\\n]*\\n\\|', ''), {_W})"
_LINE_PAIRS = rf"""asked AS (SELECT document_id, atom_index, page, trim(text, {_W}) AS line FROM qa_atoms WHERE image_key IS NULL AND NOT is_table AND ext = 'pdf' AND trim(text, {_W}) <> ''),
 q AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^\s*(?:q|question)\s*[:：]\s*(.+)$') THEN regexp_extract(line, '(?i)^\s*(?:q|question)\s*[:：]\s*(.+)$', 1)
  WHEN regexp_matches(line, '^\s*(?:[0-9]{{1,4}}[.、）)]|[-*•])\s*(.+)$') THEN regexp_extract(line, '^\s*(?:[0-9]{{1,4}}[.、）)]|[-*•])\s*(.+)$', 1) WHEN regexp_matches(line, '[?？]$') THEN line END AS q FROM asked),
 pq AS (SELECT *, sum((q IS NOT NULL)::INTEGER) OVER (PARTITION BY document_id ORDER BY atom_index) AS pair_no FROM q),
 bullets AS (SELECT document_id, min(atom_index) AS o, max(q) AS question, trim(string_agg(CASE WHEN q IS NULL THEN nullif(CASE WHEN regexp_matches(line, '(?i)^\s*(?:a|answer)\s*[:：]\s*(.*)$') THEN regexp_extract(line, '(?i)^\s*(?:a|answer)\s*[:：]\s*(.*)$', 1) ELSE line END, '') END, chr(10) ORDER BY atom_index), {_W}) AS answer,
  arg_min(page, atom_index) AS page, 'qa-bullets' AS parser_name FROM pq WHERE pair_no > 0 GROUP BY document_id, pair_no)"""


@query(
    f"""WITH {DOCS}, named AS (SELECT document_id, dataset_id, concat('f', document_id, CASE document_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.docx' ELSE '.pdf' END) AS name FROM docs), {_ATOMS_SQL},
 qa_atoms AS (SELECT atoms.* REPLACE (CASE WHEN is_table OR heading_level > 0 THEN text WHEN atom_index % 11 = 6 THEN concat('q: ', text) ELSE text END AS text), CASE document_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'docx' ELSE 'pdf' END AS ext, document_id % 3 = 1 AS pairs FROM atoms),
 {_HEADS}, {_LINE_PAIRS},
 cells AS (SELECT document_id, atom_index AS o, i, list_filter(list_transform(string_split(trim(trim(string_split(text, chr(10))[i], {_W}), '|'), '|'), lambda c: trim(c, {_W})), lambda c: c <> '') AS c FROM pathed, (VALUES (1), (3)) AS t(i) WHERE apart),
 pairs AS (SELECT *, 0 AS i FROM heads WHERE document_id % 3 <> 2 UNION ALL SELECT *, 0 FROM bullets UNION ALL SELECT document_id, o, c[1], c[2], 0, 'qa-table', i FROM cells WHERE len(c) >= 2),
 fields AS (SELECT document_id, o, i, page, parser_name, {_STRIP.replace("line", "question")} AS question, {_STRIP.replace("line", "answer")} AS answer FROM pairs WHERE trim(question, {_W}) <> '' AND answer <> ''),
 made AS (SELECT *, 'text' AS element_type, '' AS image_key, question AS embed, concat('问题：', question, chr(10), chr(10), '回答：', answer) AS content FROM fields WHERE question <> '' AND answer <> ''), {_chunks("made")}"""
)
def build_chunks_qa(spark: SparkSession, d: str) -> DataFrame:
    """Atoms as those of Markdown, Word and PDF files by document, with question labels on some lines."""
    k = F.col("document_id") % 3
    docs = documents(spark, d).withColumn("name", F.concat(F.lit("f"), F.col("document_id").cast("string"), F.when(k == 0, ".md").when(k == 1, ".docx").otherwise(".pdf"))).withColumnRenamed("content", "text")
    asked = (F.col("atom_index") % 11 == 6) & ~F.col("is_table") & (F.col("heading_level") == 0)
    return _told(chunking.build_chunks_atoms(docs, atoms(spark, d).withColumn("text", F.when(asked, F.concat(F.lit("q: "), "text")).otherwise(F.col("text"))), "qa"))


# ---------------------------------------------------------------- resumes

_MARKED = "CASE WHEN line_no % 12 = 3 THEN 'Education' WHEN line_no % 12 = 7 THEN 'Projects' WHEN line_no % 7 = 0 THEN concat('1. ', line) WHEN line_no % 12 IN (9, 10) THEN concat('2010-2012 ', substr(line, 1, 20)) ELSE line END"
_ENTRIES = rf"""{LINES}, raw AS (SELECT document_id, line_no, trim(replace(trim(regexp_replace(trim(trim({_MARKED}, '�'), {_W}), '^#{{1,6}}\s*', ''), {_W}), '\- ', '- '), {_W}) AS line FROM lines),
 l AS (SELECT *, CASE {" ".join(f"WHEN lower(trim(regexp_replace(line, '[ :：]+$', ''))) IN ({', '.join(repr(n) for n in names)}) THEN '{k}'" for k, names in structure.SECTIONS.items())} END AS kind FROM raw WHERE line <> '' AND NOT regexp_matches(line, '{structure._DECORATION}')),
 told AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no), '{structure.BASIC}') AS section FROM l),
 firsts AS (SELECT document_id, section, CASE WHEN section = '{structure.BASIC}' THEN -1 ELSE min(line_no) END AS first FROM told GROUP BY 1, 2),
 kept AS (SELECT *, regexp_matches(line, '{structure._NUMBERED}') OR b IS NULL AS mark, regexp_matches(line, '{structure._DATES}') AS dates FROM (SELECT *, lag(line) OVER (PARTITION BY document_id, section ORDER BY line_no) AS b FROM told WHERE kind IS NULL) WHERE b IS NULL OR b <> line),
 dated AS (SELECT *, last_value(CASE WHEN mark THEN dates END IGNORE NULLS) OVER (PARTITION BY document_id, section ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM kept),
 split AS (SELECT *, sum(CASE WHEN section IN ('{structure.WORK}', '{structure.PROJECT}') THEN mark OR (dates AND coalesce(old, FALSE)) ELSE b IS NULL END::INTEGER) OVER (PARTITION BY document_id, section ORDER BY line_no) AS entry FROM dated),
 entries AS (SELECT document_id, section, entry, first, arg_min(line, line_no) AS opening, string_agg(line, chr(10) ORDER BY line_no) AS text FROM split JOIN firsts USING (document_id, section) GROUP BY 1, 2, 3, 4)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents under headings of a resume, some numbered, some with dates."""
    return lines(spark, d).withColumn("line", F.expr(_MARKED))


@query(f"WITH {_ENTRIES} SELECT document_id, section, (row_number() OVER (PARTITION BY document_id ORDER BY first, entry) - 1)::INTEGER AS entry_no, text FROM entries")
def resume_sections(spark: SparkSession, d: str) -> DataFrame:
    return structure.resume_sections(_marked(spark, d))


_INTENT = structure._INTENT
_WHO = rf"""who AS (SELECT document_id, arg_min(line, (first, line_no)) FILTER (section = '{structure.BASIC}' AND regexp_matches(line, '^[\p{{L}} ·]{{1,16}}$')) AS name, arg_min(regexp_extract(line, '{structure._PHONE}'), (first, line_no)) FILTER (regexp_matches(line, '{structure._PHONE}')) AS phone,
  arg_min(regexp_extract(line, '{structure._EMAIL}'), (first, line_no)) FILTER (regexp_matches(line, '{structure._EMAIL}')) AS email, arg_min(trim(regexp_extract(line, '{_INTENT}', 1)), (first, line_no)) FILTER (trim(regexp_extract(line, '{_INTENT}', 1)) <> '') AS intent FROM told JOIN firsts USING (document_id, section) WHERE kind IS NULL GROUP BY 1),
 tails AS (SELECT document_id, concat_ws(' | ', '姓名:' || name, '电话:' || phone, '邮箱:' || email, '求职意向:' || intent) AS tail FROM who)"""


@query(
    f"""WITH RECURSIVE {_NAMED}, {_ENTRIES}, {_WHO}, several AS (SELECT *, max(entry) OVER (PARTITION BY document_id, section) AS n, row_number() OVER (PARTITION BY document_id ORDER BY first, entry) - 1 AS o FROM entries),
 heads AS (SELECT document_id, o, text, CASE WHEN section IN ('{structure.WORK}', '{structure.PROJECT}') AND n > 1 THEN concat(section, ' ', CASE WHEN length(opening) <= 36 THEN opening ELSE entry::VARCHAR END) ELSE section END AS head FROM several),
 src AS (SELECT (document_id, o) AS key, text FROM heads), {_split("src", "pieces")},
 made AS (SELECT document_id, o, piece_index AS i, concat(head, chr(10), chr(10), piece, CASE WHEN tail <> '' THEN concat(chr(10), chr(10), '[候选人摘要] ', tail) ELSE '' END) AS content, content AS embed, 'text' AS element_type, 1 AS page, 'resume-structured' AS parser_name, '' AS image_key FROM heads JOIN pieces ON key = (document_id, o) JOIN tails USING (document_id)),
 {_chunks("made")}"""
)
def build_chunks_resume(spark: SparkSession, d: str) -> DataFrame:
    made = _marked(spark, d).select("document_id", F.col("line_no").alias("atom_index"), F.col("line").alias("text"))
    return _told(chunking.build_chunks_atoms(documents(spark, d), made, "resume"))


# ---------------------------------------------------------------- Markdown and tables

_BLOCK = """CASE k WHEN 0 THEN concat('T ', b, ' ![i](a.png) after') WHEN 1 THEN concat('h', b, ' | v') WHEN 2 THEN '- -|:-:' WHEN 3 THEN concat('1 | ', b) WHEN 4 THEN '-|-' WHEN 5 THEN concat('text ', b) WHEN 6 THEN '~~~' WHEN 7 THEN 'a|b' WHEN 8 THEN '-|-' WHEN 9 THEN '~~~' WHEN 10 THEN concat('see <TABLE><tr><td>', b, '</td>') ELSE '</tr></table> end' END"""


@query(
    f"""WITH {LINES}, rows_ AS (SELECT document_id, line_no AS n, k, {_BLOCK.replace("b,", "line_no,").replace("b)", "line_no)")} AS line FROM lines, (SELECT unnest(range(0, 12)) AS k) WHERE line_no < 40),
 parts AS (SELECT document_id, n, CASE WHEN k = 0 THEN 0 WHEN k < 5 THEN 3 WHEN k < 10 THEN 4 ELSE 5 END AS p, string_agg(line, chr(10) ORDER BY k) AS text FROM rows_ GROUP BY 1, 2, 3),
 cut AS (SELECT document_id, n, p, CASE WHEN p IN (3, 5) THEN 'table' ELSE 'text' END AS element_type, CASE WHEN p = 0 THEN concat('T ', n) ELSE text END AS text FROM parts UNION ALL SELECT document_id, n, 1, 'image', '![i](a.png)' FROM parts WHERE p = 0 UNION ALL SELECT document_id, n, 2, 'text', 'after' FROM parts WHERE p = 0)
 SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY n, p) - 1)::INTEGER AS atom_index, element_type, text FROM cut"""
)
def markdown_atoms(spark: SparkSession, d: str) -> DataFrame:
    """For each of a document's first forty lines a block of twelve with an image, a pipe table, a fence and an HTML table."""
    block = F.expr(f"array_join(transform(sequence(0, 11), k -> {_BLOCK.replace('b,', 'line_no,').replace('b)', 'line_no)')}), '\n')")
    texts = lines(spark, d).where("line_no < 40").withColumn("line", block).groupBy("document_id").agg(structure.joined("line", "line_no").alias("text"))
    return chunking.markdown_atoms(texts)


@query(
    f"""WITH RECURSIVE r AS (SELECT p_partkey // 256 AS document_id, row_number() OVER (PARTITION BY p_partkey // 256 ORDER BY p_partkey) AS n, concat('| ', p_partkey, ' | ', replace(p_name, '|', '\\|'), ' | ', replace(p_type, '|', '\\|'), ' |') AS line FROM part),
 h AS (SELECT concat('| p_partkey | p_name | p_type |', chr(10), '| --- | --- | --- |', chr(10)) AS head),
 g AS (SELECT document_id, n, 0 AS part, length(line) AS size FROM r WHERE n = 1 UNION ALL SELECT r.document_id, r.n, CASE WHEN length(head) + size + 1 + length(line) > {chunking.TARGET} THEN part + 1 ELSE part END, CASE WHEN length(head) + size + 1 + length(line) > {chunking.TARGET} THEN length(line) ELSE size + 1 + length(line) END FROM g JOIN r ON r.document_id = g.document_id AND r.n = g.n + 1, h)
 SELECT document_id, part::INTEGER AS atom_index, 'table' AS element_type, concat(any_value(head), string_agg(line, chr(10) ORDER BY n)) AS text FROM g JOIN r USING (document_id, n), h GROUP BY 1, 2"""
)
def split_tables(spark: SparkSession, d: str) -> DataFrame:
    blocks = files.rows_to_markdown(table(spark, d, "part"), "part", "p_partkey", ["p_partkey", "p_name", "p_type"])
    text = F.regexp_replace("content", r"^##[^\n]*\n\n", "")
    return chunking.split_tables(blocks.select(F.col("block_no").alias("document_id"), text.alias("text")))
