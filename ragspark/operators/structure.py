"""Structure of lines and atoms: sections, question-answer pairs, resumes, repeated lines, hyphens, pages.

Lines are rows (document_id, line_no, line and others); what depends on earlier lines is a window over a document's
lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions.text import SPACE, clean_qa, heading, trimmed


def lines_of(texts: DataFrame, text: str = "text", key: str = "document_id") -> DataFrame:
    """A row for each line: the other columns, line_no from 0, line."""
    others = [c for c in texts.columns if c != text]
    return texts.select(*others, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")).alias("line_no", "line"))


def joined(value: str, order: str, sep: str = "\n") -> Column:
    """Aggregate: ``value`` in the order of ``order``, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]), sep)


def _so_far(key: str = "document_id", order: str = "line_no"):  # noqa: ANN202
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def compact_lines(lines: DataFrame) -> DataFrame:
    """Without blank lines, and without a line that equals the one before it."""
    seen = lines.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    before = F.lag("line").over(Window.partitionBy("document_id").orderBy("line_no"))
    return seen.withColumn("_before", before).where("_before IS NULL OR _before <> line").drop("_before")


def strip_running_lines(pages: DataFrame, short: int = 40) -> DataFrame:
    """Drop running headers and footers.  pages: document_id, page, line_no, line.

    A first or last line of under ``short`` characters that is one on at least half of a document's pages that have text,
    and on at least two of them, goes from all pages it starts or ends.
    """
    of_page = Window.partitionBy("document_id", "page")
    with_text = F.when(F.col("_line") != "", F.col("line_no"))
    # lines are shuffled once, by page; all else is at most two rows a page
    t = pages.withColumn("_line", trimmed(F.col("line")))
    t = t.withColumn("_lo", F.min(with_text).over(of_page)).withColumn("_hi", F.max(with_text).over(of_page))
    place = F.explode(F.array_compact(F.array(F.when(F.col("line_no") == F.col("_lo"), "first"), F.when(F.col("line_no") == F.col("_hi"), "last"))))
    ends = t.select("document_id", "page", "_line", place.alias("end"))
    n = ends.where("end = 'first'").groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"))
    often = ends.where(F.length("_line") < short).groupBy("document_id", "end", "_line").agg(F.count(F.lit(1)).alias("n")).join(n, "document_id")
    often = often.where((F.col("pages") >= 2) & (F.col("n") >= 2) & (2 * F.col("n") >= F.col("pages"))).select("document_id", "end", "_line")
    gone = ends.join(often, ["document_id", "end", "_line"], "left_semi").groupBy("document_id", "page").agg(F.max(F.col("end") == "first").alias("_head"), F.max(F.col("end") == "last").alias("_foot"))
    out = t.join(gone, ["document_id", "page"], "left")
    dropped = ((F.col("line_no") == F.col("_lo")) & F.col("_head")) | ((F.col("line_no") == F.col("_hi")) & F.col("_foot"))
    return out.where(~F.coalesce(dropped, F.lit(False))).select(*pages.columns)


def poor_text_docs(atoms: DataFrame, invalid: Column, total: Column) -> DataFrame:
    """document_id, poor: at least 3 invalid characters, and one in a hundred of all."""
    sums = atoms.groupBy("document_id").agg(F.sum(invalid).alias("invalid"), F.sum(total).alias("total"))
    return sums.withColumn("poor", (F.col("invalid") >= 3) & (F.col("invalid") * 100 >= F.col("total")))


def document_text(atoms: DataFrame) -> DataFrame:
    """Text of each document: its atoms that are not blank, in order, with an empty line between."""
    return atoms.where(trimmed(F.col("text")) != "").groupBy("document_id").agg(joined("text", "atom_index", "\n\n").alias("text"))


def merge_pages(pages: DataFrame) -> DataFrame:
    """Runs of text pages made one atom each; an image page is an atom of its own.  pages: document_id, page, text, is_image."""
    run = F.sum(F.col("is_image").cast("int")).over(_so_far(order="page"))
    rows = pages.withColumn("_run", run)
    merged = rows.groupBy("document_id", "_run", "is_image").agg(F.min("page").alias("page"), F.max("page").alias("last_page"), joined("text", "page", "\n\n").alias("text"))
    return merged.select("document_id", "page", "last_page", "is_image", "text")


# ---------------------------------------------------------------- sections


def section_paths(lines: DataFrame, template: str) -> DataFrame:
    """Sections of documents: document_id, section_no, section_path, text, no_split.

    lines: document_id, line_no, line.  A heading of level L ends all sections of level L and below; the path joins the
    open headings.  Blank lines within a section are one.  An abstract of a paper must not be split.
    """
    w = _so_far()
    h = lines.withColumn("line", trimmed(F.col("line"))).withColumn("_h", heading(F.col("line"), template))
    h = h.withColumn("_level", F.col("_h.level")).withColumn("_section", F.sum(F.col("_h").isNotNull().cast("int")).over(w))
    parts = []
    for k in range(1, 7):
        # the last heading of this level, unless one of a higher level came after it
        h = h.withColumn(f"_t{k}", F.last(F.when(F.col("_level") == k, F.struct("line_no", F.col("_h.title").alias("title"))), ignorenulls=True).over(w))
        if k > 1:
            h = h.withColumn(f"_o{k}", F.last(F.when(F.col("_level") < k, F.col("line_no")), ignorenulls=True).over(w))
            parts.append(F.when(F.coalesce(F.col(f"_o{k}"), F.lit(-1)) < F.col(f"_t{k}.line_no"), F.col(f"_t{k}.title")))
        else:
            parts.append(F.col("_t1.title"))
    path = F.array_join(F.array_compact(F.array(*parts)), " / ")
    body = h.withColumn("section_path", path).where(F.col("_h").isNull())
    # of blank lines in a row the first stays
    before = F.lag("line").over(Window.partitionBy("document_id", "_section").orderBy("line_no"))
    body = body.withColumn("_before", before).where("line <> '' OR _before <> ''")
    text = body.groupBy("document_id", "_section", "section_path").agg(trimmed(joined("line", "line_no")).alias("text")).where("text <> ''")
    last = F.lower(trimmed(F.regexp_replace(F.substring_index("section_path", " / ", -1), "[ :：]+$", "")))
    no_split = F.lit(template == "paper") & last.isin("abstract", "摘要")
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("_section")) - 1
    return text.select("document_id", number.alias("section_no"), "section_path", "text", no_split.alias("no_split"))


def with_path(path: Column, content: Column) -> Column:
    """A section's path, an empty line, and its text; the text alone if either is blank."""
    p, c = trimmed(F.coalesce(path, F.lit(""))), trimmed(content)
    return F.when((p == "") | (c == ""), c).otherwise(F.concat(p, F.lit("\n\n"), c))


# ---------------------------------------------------------------- question-answer pairs


def detect_delimiter(texts: DataFrame) -> DataFrame:
    """document_id, delimiter: tab or comma, by the lines that it splits in two; tab when equal."""
    two = lambda d: F.size(F.filter(F.split("text", "\n"), lambda x: F.size(F.split(x, d)) == 2))
    return texts.select("document_id", F.when(two("\t") >= two(","), "\t").otherwise(",").alias("delimiter"))


def pairs_of_rows(rows: DataFrame) -> DataFrame:
    """Pairs of delimited rows: document_id, pair_no, question, answer.

    rows: document_id, line_no, fields array<string>, delimiter.  A row of exactly two fields with text starts a pair; any
    other goes on with the answer before it, and is lost before the first pair.
    """
    pair = (F.size("fields") == 2) & F.forall("fields", lambda x: trimmed(x) != "")
    r = rows.withColumn("_pair", pair).withColumn("pair_no", F.sum(F.col("_pair").cast("int")).over(_so_far())).where("pair_no > 0")
    more = trimmed(F.array_join("fields", "\0"))
    text = F.when(F.col("_pair"), F.col("fields")[1]).otherwise(F.replace(more, F.lit("\0"), F.col("delimiter")))
    r = r.withColumn("_text", text).where("_pair OR _text <> ''")
    out = r.groupBy("document_id", "pair_no").agg(F.min_by(F.get("fields", F.lit(0)), "line_no").alias("question"), joined("_text", "line_no").alias("answer"))
    return out.select("document_id", "pair_no", clean_qa(F.col("question")).alias("question"), clean_qa(F.col("answer")).alias("answer")).where("question <> '' AND answer <> ''")


# fixed values: how questions, answers and list items begin
_QUESTION = r"(?iu)^\s*(?:问题|问|q|question)\s*[:：]\s*(.+)$"
_ANSWER = r"(?iu)^\s*(?:答案|回答|答|a|answer)\s*[:：]\s*(.*)$"
_BULLET = r"^\s*(?:[0-9]{1,4}[.、）)]|[-*•])\s*(.+)$"


def qa_question_lines(lines: DataFrame) -> DataFrame:
    """Pairs in plain lines: document_id, pair_no, question, answer.

    A labelled, numbered or bulleted line, or one that ends in a question mark, is a question; the lines after it, without
    their answer labels, are its answer.  Pairs without an answer are left out.  Lines with a ``page`` give each pair the
    page and the line_no of its question.
    """
    t = lines.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    x = F.col("line")
    question = F.when(x.rlike(_QUESTION), F.regexp_extract(x, _QUESTION, 1)).when(x.rlike(_BULLET), F.regexp_extract(x, _BULLET, 1)).when(x.rlike("[?？]$"), x)
    t = t.withColumn("_q", question).withColumn("pair_no", F.sum(F.col("_q").isNotNull().cast("int")).over(_so_far())).where("pair_no > 0")
    answer = F.when(F.col("_q").isNull(), F.when(x.rlike(_ANSWER), F.regexp_extract(x, _ANSWER, 1)).otherwise(x))
    t = t.withColumn("_a", F.when(answer != "", answer))
    place = [F.min_by(c, "line_no").alias(c) for c in ("line_no", "page") if "page" in lines.columns]  # of the question
    out = t.groupBy("document_id", "pair_no").agg(*place, F.max("_q").alias("question"), trimmed(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_a").isNotNull(), F.struct("line_no", "_a")))), lambda v: v["_a"]), "\n")).alias("answer"))
    return out.where((trimmed(F.col("question")) != "") & (F.col("answer") != ""))


def qa_headings(lines: DataFrame) -> DataFrame:
    """Pairs of headings and what is below them: document_id, pair_no, question (the open headings), answer.

    lines: document_id, line_no, line.  Within a code fence nothing is a heading.
    """
    w = _so_far()
    fence = trimmed(F.col("line")).startswith("```")
    t = lines.withColumn("_in", F.sum(fence.cast("int")).over(w) % 2 == 1)
    marks = F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*$", 1)
    title = trimmed(F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*$", 2))
    t = t.withColumn("_level", F.when(~F.col("_in") & (F.length(marks) > 0), F.length(marks))).withColumn("_title", title)
    t = t.withColumn("pair_no", F.sum(F.col("_level").isNotNull().cast("int")).over(w)).where("pair_no > 0")
    parts = []
    for k in range(1, 7):
        t = t.withColumn(f"_t{k}", F.last(F.when(F.col("_level") == k, F.struct("line_no", "_title")), ignorenulls=True).over(w))
        t = t.withColumn(f"_o{k}", F.last(F.when(F.col("_level") < k, F.col("line_no")), ignorenulls=True).over(w))
        parts.append(F.when(F.coalesce(F.col(f"_o{k}"), F.lit(-1)) < F.col(f"_t{k}.line_no"), F.col(f"_t{k}._title")))
    t = t.withColumn("question", F.array_join(F.array_compact(F.array(*parts)), "\n")).where("_level IS NULL")
    out = t.groupBy("document_id", "pair_no", "question").agg(trimmed(joined("line", "line_no")).alias("answer"))
    return out.where("question <> '' AND answer <> ''")


def first_cells(cells: Column) -> Column:
    """The first two cells with text, null if there are fewer."""
    two = F.slice(F.filter(F.transform(cells, trimmed), lambda c: c.isNotNull() & (c != "")), 1, 2)
    return F.when(F.size(two) == 2, two)


def qa_table_rows(rows: DataFrame) -> DataFrame:
    """question and answer of rows with a column ``cells``; rows with fewer than two cells with text are left out."""
    return rows.withColumn("_two", first_cells(F.col("cells"))).where("_two IS NOT NULL").select(*[c for c in rows.columns if c != "cells"], F.col("_two")[0].alias("question"), F.col("_two")[1].alias("answer"))


# ---------------------------------------------------------------- tables and images in Markdown


def table_cells(line: Column) -> Column:
    """Cells of a pipe-table row, one outer pipe at each end dropped; null for lines that are none (under 2 cells, or no text)."""
    inner = F.regexp_replace(F.regexp_replace(trimmed(line), r"^\|", ""), r"\|$", "")
    cells = F.transform(F.split(inner, r"\|"), trimmed)
    return F.when((F.size(cells) >= 2) & F.exists(cells, lambda c: c != ""), cells)


def is_separator(line: Column) -> Column:
    """A row of which all cells are dashes, spaces aside, with a colon at either end or none."""
    cells = table_cells(line)
    return F.coalesce(F.forall(cells, lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-+:?$")), F.lit(False))


def pipe_tables(lines: DataFrame) -> DataFrame:
    """Pipe tables: document_id, table_no, line_no, cells, is_header.

    A row that a separator follows starts a table, which goes on until a line that is no row, whatever its rows are.
    Separators are left out, but for one that is the header itself.
    """
    w = Window.partitionBy("document_id").orderBy("line_no")
    t = lines.withColumn("cells", table_cells(F.col("line"))).withColumn("_sep", is_separator(F.col("line")))
    starts = F.col("cells").isNotNull() & F.coalesce(F.lead("_sep").over(w), F.lit(False))
    t = t.withColumn("_starts", starts).withColumn("_run", F.sum(F.col("cells").isNull().cast("int")).over(_so_far())).where("cells IS NOT NULL")
    run = Window.partitionBy("document_id", "_run")
    t = t.withColumn("_head", F.min(F.when(F.col("_starts"), F.col("line_no"))).over(run)).where("line_no >= _head")
    t = t.withColumn("is_header", F.col("line_no") == F.col("_head")).withColumn("table_no", F.sum(F.col("is_header").cast("int")).over(_so_far()))
    return t.where("is_header OR NOT _sep").select("document_id", "table_no", "line_no", "cells", "is_header")


#: how images are written in Markdown and HTML; a fixed value
_IMAGE = r"(?is)!\[[^\]\n]*\]\([^)\n]*\)|<img\b[^>]*>"


def inline_images(texts: DataFrame) -> DataFrame:
    """Text and image parts in order: the other columns, part_no, element_type (text or image), text, is_data."""
    gaps, marks = F.split("text", _IMAGE, -1), F.regexp_extract_all("text", F.lit(_IMAGE), F.lit(0))
    pairs = F.transform(gaps, lambda g, i: F.array(F.struct(F.lit("text").alias("element_type"), trimmed(g).alias("text")), F.struct(F.lit("image").alias("element_type"), F.get(marks, i).alias("text"))))
    parts = F.filter(F.flatten(pairs), lambda p: p["text"].isNotNull() & (p["text"] != ""))
    others = [c for c in texts.columns if c != "text"]
    out = texts.select(*others, F.posexplode(parts).alias("part_no", "_p"))
    return out.select(*others, "part_no", "_p.element_type", "_p.text", ((F.col("_p.element_type") == "image") & F.contains(F.lower("_p.text"), F.lit("data:image"))).alias("is_data"))


# ---------------------------------------------------------------- line ends and resumes


def dehyphenate(lines: Column) -> Column:
    """An array of lines (none with a line end inside) with words joined that a hyphen between two letters splits at a line's end.

    The hyphen goes if both letters are lower-case and the next line's first word is lower-case letters throughout, else
    it stays, as in a compound.  A double hyphen joins nothing.  A merged line may be merged again.
    """
    # whether two neighbouring lines merge depends on them alone, so each line end becomes what it is, and all are joined once
    after = lambda i: F.get(lines, i + 1)

    def with_end(line: Column, i: Column) -> Column:
        splits = line.rlike(r"\p{L}-\z") & after(i).rlike(r"^\p{L}")
        goes = line.rlike(r"\p{Ll}-\z") & after(i).rlike(rf"^\p{{Ll}}+(?:{SPACE}|\z)")
        text = F.when(F.coalesce(splits & goes, F.lit(False)), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
        return F.concat(text, F.when(F.coalesce(splits, F.lit(False)) | after(i).isNull(), "").otherwise("\n"))

    return F.when(F.size(lines) == 0, lines).otherwise(F.split(F.array_join(F.transform(lines, with_end), ""), "\n", -1))


# ---- fixed values of resumes: headings of sections, and patterns
BASIC, EDUCATION, SKILLS, WORK, PROJECT, OTHER = "基本信息", "教育背景", "专业技能", "工作经历", "项目经历", "其他经历"
SECTIONS = {
    BASIC: ["个人信息", "基本信息", "个人简介", "联系方式", "profile", "personal information"],
    EDUCATION: ["教育背景", "教育经历", "学历信息", "education"],
    SKILLS: ["专业技能", "技能清单", "技能特长", "证书", "语言能力", "skills", "certificates"],
    WORK: ["工作经历", "实习经历", "任职经历", "employment", "work experience", "experience"],
    PROJECT: ["项目经历", "项目经验", "projects", "project experience"],
    OTHER: ["获奖经历", "校园经历", "社会实践", "自我评价", "个人总结", "awards", "summary"],
}
_NUMBERED = r"^\s*(?:\d{1,2}[.、）)]|[一二三四五六七八九十]{1,3}[、.）)])\s*\S+"
_DATES = r"(?i)(?:19|20)\d{2}(?:[./年-]\d{1,2})?\s*(?:[-—–~至]|to)\s*(?:(?:19|20)\d{2}(?:[./年-]\d{1,2})?|至今|现在|present)"
_PHONE = r"(?:\+?86[-\s]?)?1[3-9]\d{9}"
_EMAIL = r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"
_INTENT = r"(?i)^(?:求职意向|应聘职位|目标职位|期望职位|objective)\s*[:：]?\s*(.+)$"
_DECORATION = r"(?i)^\[(?:图片|图像|image)\]"


def told_sections(lines: DataFrame) -> DataFrame:
    """Cleaned lines of resumes with ``section``, headings among them (_kind is their section, null for other lines).  What stands before the first heading is basic."""
    clean = F.regexp_replace(trimmed(F.regexp_replace("line", "^\ufffd+|\ufffd+$", "")), r"^#{1,6}\s*", "")
    t = lines.withColumn("line", trimmed(F.replace(clean, F.lit("\\- "), F.lit("- ")))).where((F.col("line") != "") & ~F.col("line").rlike(_DECORATION))
    word = F.lower(trimmed(F.regexp_replace("line", "[ :：]+$", "")))
    kinds = F.create_map(*[F.lit(x) for k, names in SECTIONS.items() for n in names for x in (n, k)])
    return t.withColumn("_kind", F.try_element_at(kinds, word)).withColumn("section", F.coalesce(F.last("_kind", ignorenulls=True).over(_so_far()), F.lit(BASIC)))


def placed_sections(lines: DataFrame) -> DataFrame:
    """:func:`told_sections` with ``_first``, where each one's section begins; the basic section is before all others."""
    w = Window.partitionBy("document_id", "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return told_sections(lines).withColumn("_first", F.when(F.col("section") == BASIC, F.lit(-1).cast("long")).otherwise(F.min("line_no").over(w).cast("long")))


def resume_entries(told: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Entries of :func:`told_sections`: document_id, section, entry (from 1 in its section), first_line, text, and the columns ``keep``, which hold one value in a section.

    Of equal lines that follow on each other in a section one is kept.  Work and projects are split into entries: a
    numbered line starts one; so does a line with a span of dates if the first line of the current entry has one too.
    """
    by = Window.partitionBy("document_id", "section").orderBy("line_no")
    t = told.where("_kind IS NULL").withColumn("_before", F.lag("line").over(by)).where("_before IS NULL OR _before <> line")
    # Of an entry's first line only whether it has dates counts.  An entry that dates start has them, so it is as the last
    # numbered line, or the first of all, was: that is a last value, and the entries are islands.
    marks = F.col("line").rlike(_NUMBERED) | (F.row_number().over(by) == 1)
    t = t.withColumn("_mark", marks).withColumn("_dates", F.col("line").rlike(_DATES))
    dated = F.last(F.when(F.col("_mark"), F.col("_dates")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("_mark") | (F.col("_dates") & F.coalesce(F.col("_dated"), F.lit(False)))
    fresh = F.when(F.col("section").isin(WORK, PROJECT), fresh).otherwise(F.row_number().over(by) == 1)
    t = t.withColumn("_dated", dated).withColumn("_fresh", fresh)
    t = t.withColumn("entry", F.sum(F.col("_fresh").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.groupBy("document_id", "section", "entry").agg(F.min_by("line", "line_no").alias("first_line"), joined("line", "line_no").alias("text"), *[F.first(c).alias(c) for c in keep or []])


def resume_sections(lines: DataFrame) -> DataFrame:
    """Entries of resumes: document_id, section, entry_no, text.

    Sections come in the order in which they begin, basic first, and one that is taken up again goes on.
    """
    out = resume_entries(placed_sections(lines), ["_first"])
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("_first", "entry")) - 1
    return out.select("document_id", "section", number.alias("entry_no"), "text")


def contact_fields(here: Column) -> dict[str, Column]:
    """name (``here`` only), phone, email and intent of a line, null where it has none."""
    return {
        "name": F.when(here & F.col("line").rlike(r"^[\p{L} ·]{1,16}\z"), F.col("line")), "phone": F.nullif(F.regexp_extract("line", _PHONE, 0), F.lit("")),
        "email": F.nullif(F.regexp_extract("line", _EMAIL, 0), F.lit("")), "intent": F.nullif(trimmed(F.regexp_extract("line", _INTENT, 1)), F.lit("")),
    }


def contacts(told: DataFrame, order: Column, everywhere: bool = False) -> DataFrame:
    """document_id, name, phone, email, intent of lines with a section: of each the first by ``order`` that has one."""
    found = contact_fields(F.lit(True) if everywhere else F.col("section") == BASIC)
    return told.groupBy("document_id").agg(*[F.min_by(v, F.when(v.isNotNull(), order)).alias(k) for k, v in found.items()])


def contact_entities(lines: DataFrame, everywhere: bool = False) -> DataFrame:
    """document_id, name, phone, email, intent of resumes: of each the first line that has one.

    A name is a line of the basic section (``everywhere``: any line) of at most 16 letters, spaces and middle dots; an
    intent stands after its label at the start of a line.
    """
    got = contacts(told_sections(lines).where("_kind IS NULL"), F.col("line_no"), everywhere)
    return lines.select("document_id").distinct().join(got, "document_id", "left")


def verify_entities(given: DataFrame, texts: DataFrame, ruled: DataFrame, fields: list[str]) -> DataFrame:
    """Fields that a model gave are kept if the text has them, else those found by rule are."""
    r = ruled.select("document_id", *[F.col(f).alias(f"_{f}") for f in fields])
    rows = texts.select("document_id", "text").join(given, "document_id", "left").join(r, "document_id", "left")
    kept = lambda f: F.coalesce(F.when((trimmed(F.col(f)) != "") & F.contains(F.col("text"), trimmed(F.col(f))), trimmed(F.col(f))), F.col(f"_{f}"))
    return rows.select("document_id", *[kept(f).alias(f) for f in fields])


def claim_lines(lines: DataFrame, selections: DataFrame) -> DataFrame:
    """Groups that a model selected by line numbers: document_id, group_no, type, title, text.

    lines: document_id, line_no, line; selections: document_id, response (JSON list of {type, title, lines}).  Numbers out
    of range are dropped, the first group to claim a line gets it, lines that none claims become a group ``other``.  A
    blank title is the first line of at most 36 characters.
    """
    groups = F.from_json("response", "array<struct<type:string,title:string,lines:array<int>>>")
    g = selections.select("document_id", F.posexplode(groups).alias("group_no", "g")).select("document_id", "group_no", "g.type", "g.title", F.explode("g.lines").alias("line_no"))
    claimed = g.join(lines, ["document_id", "line_no"])
    first = Window.partitionBy("document_id", "line_no").orderBy("group_no")
    claimed = claimed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rest = lines.join(claimed.select("document_id", "line_no"), ["document_id", "line_no"], "left_anti").where(trimmed(F.col("line")) != "")
    rest = rest.select("document_id", "line_no", F.lit(1 << 20).alias("group_no"), F.lit("other").alias("type"), F.lit("").alias("title"), "line")
    every = claimed.select(*rest.columns).unionByName(rest)
    out = every.groupBy("document_id", "group_no", "type").agg(F.max("title").alias("_t"), F.min_by("line", F.when(F.length("line") <= 36, F.col("line_no"))).alias("_short"), joined("line", "line_no").alias("text"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("group_no")) - 1
    return out.select("document_id", number.alias("group_no"), "type", F.coalesce(F.nullif(trimmed(F.col("_t")), F.lit("")), "_short", F.lit("")).alias("title"), "text")
