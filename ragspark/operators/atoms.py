"""From a parser's atoms to chunks: sections over mixed atoms, runs of plain text joined, resumes, question-answer pairs.

Atoms are rows (document_id, atom_index, text) with, where a parser gives them, element_type, page, bbox, parser_name,
is_table, heading_level, image_key (where an image is kept), need_vision (a scan, which means nothing without a
description) and description (what a vision model said; null if none was asked).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions.text import MARKDOWN, clean_qa, extension, heading, trimmed
from ragspark.operators import structure
from ragspark.operators.structure import BASIC, PROJECT, WORK, first_cells, is_separator, joined, table_cells

#: columns of an atom besides document_id, atom_index and text: type and default, in SQL
COLUMNS = {
    "element_type": ("string", "''"), "page": ("int", "0"), "bbox": ("array<double>", "array()"), "parser_name": ("string", "''"), "is_table": ("boolean", "false"), "heading_level": ("int", "0"),
    "image_key": ("string", "null"), "need_vision": ("boolean", "false"), "description": ("string", "null"), "section_path": ("string", "''"), "boundary": ("boolean", "false"), "no_split": ("boolean", "false"),
}
#: where a chunk comes from
SOURCE = ["page", "bbox", "parser_name", "image_key"]
#: kinds of atoms whose lines may be headings or belong to a section; a fixed value
STRUCTURED = ("", "text", "title", "paragraph", "section_header", "list")
#: fixed values of chunk texts
IMAGE_MARK, NO_DESCRIPTION, SUMMARY = "[图片] ", "（无文字描述）", "[候选人摘要] "
_MOST_IMAGE_BYTES = 20 << 20


def complete(atoms: DataFrame) -> DataFrame:
    """Atoms with all columns; what is missing or null has its default."""
    value = lambda c, kind, default: f"cast(coalesce({c if c in atoms.columns else 'null'}, {default}) as {kind}) AS {c}"
    return atoms.selectExpr("document_id", "cast(atom_index as long) AS atom_index", "coalesce(text, '') AS text", *[value(c, kind, default) for c, (kind, default) in COLUMNS.items()])


def is_marked(name: Column) -> Column:
    """Whether a file of that name is Markdown."""
    return extension(name).isin("md", "markdown")


def document_atoms(documents: DataFrame) -> DataFrame:
    """Atoms of text files (document_id, name, text): Markdown by its elements, other texts whole.

    An image whose data is in the text gets a key, and its label as text; other images stay as they are written.
    """
    from ragspark.operators.chunking import markdown_atoms

    marked = is_marked(F.col("name"))
    plain = documents.where(~marked & (F.col("text") != "")).select("document_id", F.lit(0).alias("atom_index"), F.lit("text").alias("element_type"), "text")
    found = plain.unionByName(markdown_atoms(documents.where(marked)))
    image = r"(?is)^!\[([^\]\n]*)\]\(\s*<?(data:image/([a-z0-9.+-]+)[^,\s)>]*;base64),([^\s)>]+)>?"
    part = lambda k: F.regexp_extract("text", image, k)
    held = (F.col("element_type") == "image") & F.col("text").rlike(image) & (F.length(part(4)) * 3 <= 4 * _MOST_IMAGE_BYTES) & (F.octet_length(F.try_to_binary(part(4), F.lit("base64"))) > 0)
    kind = F.lower(part(3))
    ending = F.when(kind == "jpeg", "jpg").when(kind.isin("gif", "webp", "bmp"), kind).otherwise("png")
    key = F.concat(F.col("document_id").cast("string"), F.lit("/images/"), F.col("atom_index").cast("string"), F.lit("."), ending)
    held = F.coalesce(held, F.lit(False))
    return complete(found.select("document_id", "atom_index", F.when(held, trimmed(part(1))).otherwise(F.col("text")).alias("text"), "element_type", (F.col("element_type") == "table").alias("is_table"), F.when(held, key).alias("image_key"), F.when(held, "markdown").otherwise("").alias("parser_name")))


def _lines(atoms: DataFrame, whole: Column) -> DataFrame:
    """A row for each line, ``whole`` atoms in one: ``pos`` orders the rows of a document."""
    split = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n", -1)
    rows = atoms.select(*[c for c in atoms.columns if c != "text"], F.posexplode(F.when(whole, F.array("text")).otherwise(split)).alias("_n", "line"))
    return rows.withColumn("pos", F.shiftleft("atom_index", 32) + F.col("_n"))


def _so_far() -> Window:
    return Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def open_headings(rows: DataFrame, sep: str, levels: int = 6) -> DataFrame:
    """Adds ``path``: the titles of the open headings.  rows: document_id, pos, _level (null for no heading), _title.

    A heading closes all of its level and below.
    """
    # all in one pass of one window: the last heading of each level, and where the last one above it was
    w, found = _so_far(), {}
    for k in range(1, levels + 1):
        found[f"_h{k}"] = F.last(F.when(F.col("_level") == k, F.struct("pos", F.nullif(F.col("_title"), F.lit("")).alias("title"))), ignorenulls=True).over(w)
        found[f"_a{k}"] = F.max(F.when(F.col("_level") < k, F.col("pos"))).over(w)
    open_ = [F.when(F.coalesce(F.col(f"_a{k}"), F.lit(-1)) < F.col(f"_h{k}.pos"), F.col(f"_h{k}.title")) for k in range(1, levels + 1)]
    return rows.withColumns(found).withColumn("path", F.array_join(F.array_compact(F.array(*open_)), sep)).drop(*found)


def section_atoms(atoms: DataFrame, template: str) -> DataFrame:
    """Atoms of a book or paper by section: lines below a heading are one atom with the path of the open headings.

    Tables, images and other kinds end the text before them and stay atoms of their own, with their path.  Text of a parser
    that tells places is not joined across its atoms.  A section has the page, box and parser of its first line; of blank
    lines in a row one stays.  A paper's abstract must not be split.
    """
    a = complete(atoms)
    structured = F.col("image_key").isNull() & ~F.col("is_table") & F.col("element_type").isin(*STRUCTURED)
    rows = _lines(a.withColumn("_structured", structured), ~F.col("_structured"))
    w = _so_far()
    before = Window.partitionBy("document_id").orderBy("pos")
    clean = trimmed(F.regexp_replace(trimmed(F.col("line")), "^�+|�+$", ""))
    h = F.when(F.col("_structured") & (trimmed(F.col("line")) != ""), heading(clean, template, F.col("element_type")))
    rows = rows.withColumn("_h", h).withColumn("_level", F.col("_h.level")).withColumn("_title", F.col("_h.title"))
    rows = open_headings(rows.withColumn("_prior", F.lag("parser_name").over(before)), " / ")
    ends = F.col("_level").isNotNull() | ~F.col("_structured") | ((F.col("_n") == 0) & (F.coalesce("_prior", F.lit("")) != ""))
    rows = rows.withColumn("_group", F.sum(ends.cast("int")).over(w)).where(F.col("_level").isNull() | ~F.col("_structured"))
    # other kinds begin a group, so they are told from the lines after them by _structured; both in one pass, as rows cost much
    rows = rows.withColumn("line", F.when(F.col("_structured"), trimmed(F.col("line"))).otherwise(F.col("line")))
    last = F.lag("line").over(Window.partitionBy("document_id", "_group", "_structured").orderBy("pos"))
    rows = rows.withColumn("_last", last).where("NOT _structured OR line <> '' OR _last <> ''")
    kept = [c for c in COLUMNS if c not in ("section_path", "boundary", "no_split")]
    base = F.min_by(F.struct("pos", *kept), F.when(~F.col("_structured") | (F.col("line") != ""), F.col("pos")))
    text = rows.groupBy("document_id", "_group", "path", "_structured").agg(joined("line", "pos").alias("text"), base.alias("_b"))
    text = text.withColumn("text", F.when(F.col("_structured"), trimmed(F.col("text"))).otherwise(F.col("text"))).where("NOT _structured OR text <> ''")
    name = F.lower(trimmed(F.regexp_replace(F.substring_index("path", " / ", -1), "[ :：]+$", "")))
    # a section has its first line's place, but not its kind
    own = {"element_type": F.lit("text"), "is_table": F.lit(False), "heading_level": F.lit(0), "image_key": F.lit(None), "need_vision": F.lit(False), "description": F.lit(None)}
    value = lambda c: F.when(F.col("_structured"), own[c]).otherwise(F.col(f"_b.{c}")).alias(c) if c in own else F.col(f"_b.{c}")
    no_split = F.col("_structured") & F.lit(template == "paper") & name.isin("abstract", "摘要")
    out = text.select("document_id", F.col("_b.pos").alias("atom_index"), "text", *[value(c) for c in kept], F.col("path").alias("section_path"), no_split.alias("no_split"))
    return complete(out).withColumn("boundary", F.lit(True))


def failed_documents(atoms: DataFrame) -> DataFrame:
    """document_id, reason of documents that only a vision model can read, where none was asked."""
    a = complete(atoms)
    unseen = F.col("image_key").isNotNull() & F.col("description").isNull()
    by = a.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"), F.max(unseen & F.col("need_vision")).alias("_scan"), F.max(unseen & (F.col("parser_name") == "")).alias("_image"))
    return by.where("_scan OR (_n = 1 AND _image)").select("document_id", F.when(F.col("_scan"), "a scan needs a vision model").otherwise("an image needs a vision model").alias("reason"))


def readable(atoms: DataFrame) -> DataFrame:
    """Complete atoms without those of :func:`failed_documents`, told in the pass that deals atoms out by document."""
    w = Window.partitionBy("document_id").orderBy("atom_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    unseen = F.col("image_key").isNotNull() & F.col("description").isNull()
    failed = F.max(unseen & F.col("need_vision")).over(w) | ((F.count(F.lit(1)).over(w) == 1) & unseen & (F.col("parser_name") == ""))
    return complete(atoms).withColumn("_failed", failed).where("NOT _failed").drop("_failed")


def units(atoms: DataFrame, sections: bool = False) -> DataFrame:
    """What is split by itself: document_id, atom_index, mode (split, table, whole), head, text, element_type and SOURCE.

    Plain atoms that follow on each other are one text, with an empty line between; any other atom ends such a run.
    Sections, text that a parser placed, tables and images stand alone and keep their place.  An image is its label and
    its description; one without either that no parser placed is left out, but ends a run as well.  ``sections``: all
    atoms are of :func:`section_atoms`, so none is plain.
    """
    a = complete(atoms)
    kind = F.when(F.col("image_key").isNotNull(), "image").when(F.col("is_table"), "table").when(F.col("element_type") == "image", "figure")
    kind = kind.when(F.col("boundary"), "section").when(F.col("parser_name") != "", "placed").otherwise("plain")
    label = trimmed(F.col("text"))
    told = F.when(F.col("element_type") != "formula", F.nullif(trimmed(F.col("description")), F.lit("")))
    caption = F.nullif(label, F.lit(""))
    seen = F.coalesce(F.nullif(F.concat_ws("\n", caption, F.when(told.eqNullSafe(caption), None).otherwise(told)), F.lit("")), F.lit(NO_DESCRIPTION))
    seen = F.when(F.col("element_type") == "formula", seen).otherwise(F.concat(F.lit(IMAGE_MARK), seen))
    text = F.when(F.col("_kind") == "image", seen).when(F.col("_kind") == "figure", label).otherwise(F.col("text"))
    mode = F.when(F.col("_kind") == "table", "table").when(F.col("_kind").isin("image", "figure") | F.col("no_split"), "whole").otherwise("split")
    hidden = (F.col("_kind") == "image") & F.col("description").isNull() & (F.col("parser_name") == "") & (label == "")
    head = F.when(F.col("_kind") == "placed", "").otherwise(trimmed(F.col("section_path")))
    alone = {"mode": mode, "head": head, "element_type": F.coalesce(F.nullif(trimmed(F.col("element_type")), F.lit("")), F.lit("text"))} | {c: F.col(c) for c in SOURCE}
    if sections:
        return a.withColumn("_kind", kind).where(~hidden).select("document_id", "atom_index", alone["mode"].alias("mode"), head.alias("head"), text.alias("text"), alone["element_type"].alias("element_type"), *SOURCE)
    run = F.sum((F.col("_kind") != "plain").cast("int")).over(Window.partitionBy("document_id").orderBy("atom_index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    a = a.withColumn("_kind", kind).withColumn("_run", run).where(~hidden)
    # an atom that is not plain begins a run, so it is told from the plain ones after it: one pass for both
    plain = F.col("_kind") == "plain"
    none = {"mode": F.lit("split"), "head": F.lit(""), "element_type": F.lit("text")} | {c: F.expr(f"cast({COLUMNS[c][1]} as {COLUMNS[c][0]})") for c in SOURCE}
    rows = a.select("document_id", "atom_index", "_run", plain.alias("_plain"), text.alias("text"), F.struct(*[F.when(plain, none[c]).otherwise(v).alias(c) for c, v in alone.items()]).alias("_u"))
    out = rows.groupBy("document_id", "_run", "_plain").agg(F.min("atom_index").alias("atom_index"), joined("text", "atom_index", "\n\n").alias("text"), F.first("_u").alias("_u"))
    return out.select("document_id", "atom_index", "_u.mode", "_u.head", "text", "_u.element_type", *[f"_u.{c}" for c in SOURCE])


# ---------------------------------------------------------------- resumes


def resume_lines(atoms: DataFrame) -> DataFrame:
    """Lines of resumes (document_id, line_no, line, parser_name); pictures, charts and formulas are left out."""
    a = complete(atoms).where(F.col("image_key").isNull() & ~F.col("element_type").isin("image", "chart", "formula"))
    return _lines(a, F.lit(False)).select("document_id", F.col("pos").alias("line_no"), "line", "parser_name")


def resume_units(atoms: DataFrame) -> DataFrame:
    """Units of resumes, as of :func:`units`: an entry each, with a title as ``head`` and what is known of the person as ``tail``.

    An entry's title is its section, followed by its first line (or its number, if that has over 36 characters) where a
    section of work or projects has several.
    """
    told = structure.placed_sections(resume_lines(atoms))
    # the first phone, e-mail and intent in the order of sections
    whole = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plain = F.col("_kind").isNull()
    who = {k: F.min_by(v, F.when(plain & v.isNotNull(), F.struct("_first", "line_no"))).over(whole) for k, v in structure.contact_fields(F.col("section") == BASIC).items()}
    labels = {"name": "姓名", "phone": "电话", "email": "邮箱", "intent": "求职意向"}
    summary = F.concat_ws(" | ", *[F.concat(F.lit(f"{v}:"), who[k]) for k, v in labels.items()])
    parser = F.min_by("parser_name", F.when(F.col("parser_name") != "", F.col("line_no"))).over(Window.partitionBy("document_id", "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    told = told.withColumn("tail", summary).withColumn("parser_name", parser)
    entries = structure.resume_entries(told, ["_first", "tail", "parser_name"])
    several = F.max("entry").over(Window.partitionBy("document_id", "section")) > 1
    short = F.when(F.length(trimmed(F.col("first_line"))) <= 36, trimmed(F.col("first_line"))).otherwise(F.col("entry").cast("string"))
    title = F.when(F.col("section").isin(WORK, PROJECT) & several, F.concat("section", F.lit(" "), short)).otherwise(F.col("section"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("_first", "entry")) - 1
    rows = entries.withColumn("head", title).withColumn("atom_index", number.cast("long"))
    return rows.select(
        "document_id", "atom_index", F.lit("split").alias("mode"), "head", "text", F.coalesce("tail", F.lit("")).alias("tail"), F.lit("text").alias("element_type"), F.lit(1).alias("page"),
        F.expr("cast(array() as array<double>)").alias("bbox"), F.concat_ws("/", F.lit("resume-structured"), "parser_name").alias("parser_name"), F.lit(None).cast("string").alias("image_key"),
    )


# ---------------------------------------------------------------- question-answer pairs


def heading_pairs(atoms: DataFrame) -> DataFrame:
    """Pairs in reading order: document_id, pos, row_no, question, answer, page, parser_name.

    The open headings are the question and what is below them, up to the next heading, the answer.  In atoms with a true
    column ``tables_as_pairs`` a table ends an answer, and the first two cells with text of each of its rows are a pair;
    elsewhere tables are part of the answer.  Nothing is a heading within a code fence.
    """
    flag = F.coalesce(F.col("tables_as_pairs"), F.lit(False)) if "tables_as_pairs" in atoms.columns else F.lit(False)
    flags = atoms.select("document_id", flag.alias("_pairs")).groupBy("document_id").agg(F.max("_pairs").alias("_pairs"))
    a = complete(atoms).where("image_key IS NULL").join(flags, "document_id")
    a = a.withColumn("_named", ~F.col("is_table") & (F.col("element_type") == "title") & (F.col("heading_level") > 0))
    rows = _lines(a, F.col("is_table") | F.col("_named"))
    text = ~F.col("is_table") & ~F.col("_named")
    inside = F.sum((text & trimmed(F.col("line")).startswith("```")).cast("int")).over(_so_far()) % 2 == 1
    marks = F.length(F.regexp_extract("line", MARKDOWN, 1))
    rows = rows.withColumn("_level", F.when(F.col("_named"), F.col("heading_level")).when(text & ~inside & (marks > 0), marks))
    rows = rows.withColumn("_title", trimmed(F.when(F.col("_named"), F.col("line")).otherwise(F.regexp_extract("line", MARKDOWN, 2))))
    rows = open_headings(rows, "\n", 9)
    table = F.col("is_table") & F.col("_pairs")
    rows = rows.withColumn("_part", F.sum((F.col("_level").isNotNull() | table).cast("int")).over(_so_far()))
    body = rows.where(F.col("_level").isNull() & ~table & (F.col("path") != ""))
    heads = body.groupBy("document_id", "_part", "path").agg(F.min("pos").alias("pos"), trimmed(joined("line", "pos")).alias("answer"))
    heads = heads.select("document_id", "pos", F.lit(0).alias("row_no"), F.col("path").alias("question"), "answer", F.lit("qa-heading").alias("parser_name"))
    cells = rows.where(table).select("document_id", "pos", F.posexplode(F.split("line", "\n")).alias("row_no", "line")).where(~is_separator(F.col("line")))
    cells = cells.withColumn("_two", first_cells(table_cells(F.col("line")))).where("_two IS NOT NULL")
    both = heads.unionByName(cells.select("document_id", "pos", "row_no", F.col("_two")[0].alias("question"), F.col("_two")[1].alias("answer"), F.lit("qa-table").alias("parser_name")))
    return both.where("question <> '' AND answer <> ''").withColumn("page", F.lit(0))


def line_pairs(atoms: DataFrame) -> DataFrame:
    """Pairs of question lines in the text of atoms, as of :func:`heading_pairs`; the page is that of the question."""
    a = complete(atoms).where("image_key IS NULL AND NOT is_table")
    rows = _lines(a, F.lit(False)).select("document_id", F.col("pos").alias("line_no"), "line", "page")
    got = structure.qa_question_lines(rows)
    return got.select("document_id", F.col("line_no").alias("pos"), F.lit(0).alias("row_no"), "question", "answer", F.lit("qa-bullets").alias("parser_name"), "page")


def qa_pairs(documents: DataFrame, atoms: DataFrame) -> DataFrame:
    """Pairs that become chunks: document_id, pair_no, question, answer, page, parser_name.

    documents: document_id, name, text.  Delimited texts (txt, csv) give their rows; Markdown and Word files pairs of
    headings, the latter of their tables too; PDF of question lines, as do other files without any pair.
    """
    from ragspark.sources.qa import qa_delimited

    ext = extension(F.col("name"))
    kinds = documents.select("document_id", F.when(ext.isin("md", "markdown"), "heading").when(ext == "docx", "word").when(ext == "pdf", "line").otherwise("rest").alias("_kind"))
    columns = ["document_id", "_order", "pos", "row_no", "question", "answer", "page", "parser_name"]
    given = qa_delimited(documents.where(ext.isin("txt", "csv")).select("document_id", "text"))
    given = given.select("document_id", F.lit(0).alias("_order"), F.col("pair_no").cast("long").alias("pos"), F.lit(0).alias("row_no"), "question", "answer", F.lit(0).alias("page"), F.lit("qa-delimited").alias("parser_name"))
    a = atoms.join(kinds, "document_id")
    heads = heading_pairs(a.where("_kind IN ('heading', 'word')").withColumn("tables_as_pairs", F.col("_kind") == "word")).withColumn("_order", F.lit(1))
    asked = line_pairs(a.where("_kind = 'line'").unionByName(a.where("_kind = 'rest'").join(given, "document_id", "left_anti"))).withColumn("_order", F.lit(1))
    every = reduce(DataFrame.unionByName, [x.select(*columns) for x in (given, heads, asked)])
    every = every.withColumn("question", clean_qa(F.col("question"))).withColumn("answer", clean_qa(F.col("answer"))).where("question <> '' AND answer <> ''")
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("_order", "pos", "row_no")) - 1
    return every.select("document_id", number.alias("pair_no"), "question", "answer", "page", "parser_name")
