"""Two-column question-answer texts."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ragspark.operators.structure import detect_delimiter, lines_of, pairs_of_rows


@F.pandas_udf(ArrayType(StringType()))
def _quoted(lines: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, delimiter in lines:
        yield pd.Series([next(csv.reader([t], delimiter=d), []) for t, d in zip(text, delimiter, strict=True)])


def qa_delimited(documents: DataFrame) -> DataFrame:
    """Pairs of documents (document_id, text): document_id, pair_no, question, answer.

    The delimiter is the one that splits more lines in two.  Only lines with a quote go through Python's CSV reader.
    """
    lines = lines_of(documents.select("document_id", "text")).join(detect_delimiter(documents), "document_id").where("line <> ''")
    plain = lines.where("NOT contains(line, '\"')").withColumn("fields", F.split("line", F.col("delimiter")))
    rest = lines.where("contains(line, '\"')").withColumn("fields", _quoted("line", "delimiter"))
    return pairs_of_rows(plain.unionByName(rest))
