"""Files of a corpus: routing by extension, decoding, and layout items of an external parser."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ragspark.functions.text import extension, trimmed

#: extension -> templates that take it; fixed values.  Binary formats need an external parser, see layout_json_atoms.
TEXT = ("txt", "md", "markdown")
BINARY = ("pdf", "docx", "xlsx")


def _text_of(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[2:].decode(name, "replace")
    try:
        return raw.decode("gb18030")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")


@F.arrow_udf(StringType())
def _decoded(raw: pa.Array) -> pa.Array:
    # 256 files at a time: a batch of Spark's has up to 10,000, of which only these are Python objects at once
    parts = [pa.array([_text_of(x) for x in raw.slice(lo, 256).to_pylist()], pa.string()) for lo in range(0, len(raw), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def decode_text(df: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Adds ``out``: UTF-8 with or without mark, UTF-16 by its mark, else GB18030, else UTF-8 with replacements.

    Valid UTF-8 never leaves the JVM; only the other rows go through Python.
    """
    raw = F.col(content)
    hexed = F.hex(F.substring(raw, 1, 3))
    wide = hexed.startswith("FFFE") | hexed.startswith("FEFF")
    plain = ~wide & F.is_valid_utf8(raw.cast("string"))
    rows = df.withColumn("_plain", F.coalesce(plain, F.lit(True)))
    fine = rows.where("_plain").withColumn(out, F.regexp_replace(raw.cast("string"), "^﻿", ""))
    rest = rows.where("not _plain").withColumn(out, _decoded(raw))
    return fine.unionByName(rest).drop("_plain")


def read_corpus(spark: SparkSession, path: str, template: str = "general", glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (path, name, extension, size, file_hash, text) under ``path``, and rejects (path, reason)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("extension", extension(F.col("name")))
    allowed = [*TEXT, *(["csv"] if template == "qa" else [])]
    ext = F.col("extension")
    reason = F.when(ext == "csv", None if template == "qa" else "CSV files are for the qa template").when(ext.isin(*BINARY), "needs an external parser").when(~ext.isin(*allowed), "unknown type")
    files = files.withColumn("reason", reason)
    good = decode_text(files.where("reason IS NULL").select("path", "name", "extension", F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"), "content")).drop("content")
    return good, files.where("reason IS NOT NULL").select("path", "reason")


LAYOUT = (
    "array<struct<type:string,text:string,text_level:int,page_idx:int,bbox:array<double>,table_body:string,table_caption:array<string>,table_footnote:array<string>,"
    "image_caption:array<string>,image_footnote:array<string>,chart_caption:array<string>,chart_footnote:array<string>,code_body:string,list_items:array<string>>>"
)


def layout_json_atoms(files: DataFrame, column: str = "json") -> DataFrame:
    """Atoms of an external parser's layout: document_id, atom_index, text, element_type, heading_level, page, bbox, is_table.

    Headers, footers, page numbers and discarded items are left out, as are items without text.
    """
    items = files.select("document_id", F.posexplode(F.from_json(column, LAYOUT)).alias("atom_index", "i"))
    lines = lambda *c: F.array_join(F.filter(F.concat(*[F.coalesce(x, F.expr("cast(array() as array<string>)")) for x in c]), lambda s: trimmed(s) != ""), "\n")
    i = lambda c: F.col(f"i.{c}")
    kind = F.lower(i("type"))
    text = (
        F.when(kind.isin("text", "title") & (F.coalesce(i("text_level"), F.lit(0)) > 0), F.concat(F.repeat(F.lit("#"), F.least(i("text_level"), F.lit(6))), F.lit(" "), trimmed(i("text"))))
        .when(kind == "table", lines(i("table_caption"), F.array(i("table_body")), i("table_footnote")))
        .when(kind == "image", lines(i("image_caption"), i("image_footnote")))
        .when(kind == "chart", lines(i("chart_caption"), i("chart_footnote")))
        .when(kind == "code", F.when(trimmed(i("code_body")) != "", F.concat(F.lit("```\n"), i("code_body"), F.lit("\n```"))))
        .when(kind == "list", lines(i("list_items")))
        .when(kind.isin("header", "footer", "page_number", "discarded"), None)
        .otherwise(trimmed(i("text")))
    )
    level = F.when(kind.isin("text", "title"), F.coalesce(i("text_level"), F.lit(0))).otherwise(0)
    none = F.expr("cast(array() as array<double>)")
    rows = items.select("document_id", "atom_index", text.alias("text"), kind.alias("element_type"), level.alias("heading_level"), (i("page_idx") + 1).alias("page"), F.coalesce(i("bbox"), none).alias("bbox"), (kind == "table").alias("is_table"))
    return rows.where("text <> ''")


def cell(x):  # noqa: ANN001, ANN201
    """A value as the cell of a Markdown table."""
    return F.replace(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), "\r?\n", "<br>"), F.lit("|"), F.lit("\\|"))


def rows_to_markdown(df: DataFrame, title: str, order: str, columns: list[str] | None = None, block: int = 256, group: str | None = None) -> DataFrame:
    """Markdown tables of at most ``block`` rows each: (group,) block_no, content.

    Rows are numbered by ``order``, a column of distinct non-negative integers in which blocks are cut; the range is in
    the title of each block.  With ``group``, each group has blocks of its own.
    """
    columns = columns or [c for c in df.columns if c != group]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |"))
    keys = [group] if group else []
    rows = df.select(*keys, F.col(order).alias("_o"), line.alias("_l")).withColumn("block_no", F.floor(F.col("_o") / block))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda x: x["_l"]), "\n")
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    out = rows.groupBy(*keys, "block_no").agg(text.alias("_t"), F.min("_o").alias("_a"), F.max("_o").alias("_b"))
    name = F.concat(F.lit(f"## {title} ("), F.col("_a").cast("string"), F.lit("-"), F.col("_b").cast("string"), F.lit(")\n\n"))
    return out.select(*keys, "block_no", F.concat(name, F.lit(head), "_t").alias("content"))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors see; where that is unset a local session gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="ragspark-core-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return f"{where.rstrip('/')}/ragspark-core/{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON files as they arrive, in the column ``value``."""
    return spark.readStream.format("text").load(path)
