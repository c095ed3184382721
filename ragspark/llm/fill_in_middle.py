"""Fill-in-the-middle transformation with a wavelet matrix over character classes (operator 13).

Bytes of UTF-8 fall into classes: inside a character, a character, one that starts a word, a line, or both.  A wavelet
matrix over the classes answers how many bytes of a class stand before a place; sums of such ranks count characters,
words or lines.  Both cuts of a text are found by bisection on these counts, for all texts of a slice at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, table, text_slices

MARKS = ("<P>", "<S>", "<M>")
#: classes of bytes; the last two bits tell what starts there
INSIDE, PLAIN, WORD, LINE, WORD_LINE = range(5)
#: unit -> the classes that begin one
UNITS = {"char": (PLAIN, WORD, LINE, WORD_LINE), "word": (WORD, WORD_LINE), "line": (LINE, WORD_LINE)}
_ONES = np.array([bin(x).count("1") for x in range(256)], np.int64)
_BELOW = np.array([(1 << k) - 1 for k in range(8)], np.uint8)


class WaveletMatrix:
    """How often a symbol stands before a place.  A level for each bit; each splits the sequence stably by its bit.  Takes five eighths of a byte a symbol and level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            one = (symbols >> b & 1).astype(bool)
            packed = np.append(np.packbits(one, bitorder="little"), np.uint8(0))
            before = np.zeros(len(packed), np.int32)
            np.cumsum(_ONES[packed[:-1]], out=before[1:])
            zeros = len(symbols) - int(np.count_nonzero(one))
            self.levels.append((b, packed, before, zeros))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``."""
        lo, hi = np.zeros_like(at), at
        for b, packed, before, zeros in self.levels:
            ones = [before[x >> 3] + _ONES[packed[x >> 3] & _BELOW[x & 7]] for x in (lo, hi)]
            lo, hi = (zeros + ones[0], zeros + ones[1]) if symbol >> b & 1 else (lo - ones[0], hi - ones[1])
        return hi - lo


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that begin at ``offsets``."""
    before = np.empty_like(data)
    before[1:] = data[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = 10  # a text's start starts a line
    word = SPACED[data] & ~SPACED[before]
    out = (PLAIN + word + 2 * (before == 10)).astype(np.uint8)
    out[data & 0xC0 == 0x80] = INSIDE
    return out


def boundaries(matrix: WaveletMatrix, unit: str, at: np.ndarray) -> np.ndarray:
    """How many units begin before ``at``."""
    if unit == "char":
        return at - matrix.rank(INSIDE, at)
    return sum(matrix.rank(c, at) for c in UNITS[unit])


def locate(matrix: WaveletMatrix, unit: str, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the first ``k`` units of each text end: the start of unit k + 1, or the text's end.  What stands before the first unit belongs to it from k = 1 on."""
    none = k == 0
    first, a, b = lo, lo.copy(), hi.copy()
    want = boundaries(matrix, unit, lo) + k
    while (a < b).any():  # the last place that no more than k units begin before
        mid = (a + b + 1) >> 1
        fits = boundaries(matrix, unit, mid) <= want
        a, b = np.where(fits, mid, a), np.where(fits, b, mid - 1)
    return np.where(none, first, a)


def fill_in_middle(docs: DataFrame, unit: str = "char", plain: int = 10, spm: int = 20, seed: int = 1, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Every text cut in prefix, middle and suffix: doc_id, n, form, prefix_chars, middle_chars, output.

    ``n``: its units (``char``: code points; ``word``: a word with the white space after it; ``line``).  The cuts are the
    units h1 % (n + 1) and h2 % (n + 1), in order, with h1 to h4 from the sha256 of ``seed`` and doc_id.  ``plain`` percent
    (h3) of texts stay as they are, as do empty ones and those with one of ``marks``; of the others ``spm`` percent (h4) have
    the suffix first.  prefix_chars and middle_chars count code points, null if plain.

    A null text is empty; a null id counts as no digits; repeated rows give a row each.  Other columns are ignored, and an
    empty table gives an empty result.
    """
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *draws)
    pre, suf, mid = (m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                matrix = WaveletMatrix(classes(data, offsets), 3)
                start, end = offsets[:-1], offsets[1:]
                n = boundaries(matrix, unit, end) - boundaries(matrix, unit, start)
                one, two = (h[k][lo:hi] % (n + 1) for k in (0, 1))
                a, b = (locate(matrix, unit, start, end, f(one, two)) for f in (np.minimum, np.maximum))
                chars = [boundaries(matrix, "char", x) for x in (start, a, b)]
                whole = (start == end) | (h[2][lo:hi] % 100 >= 100 - plain)
                back = h[3][lo:hi] % 100 < spm
                raw = data.tobytes()
                forms, out = [], []
                for s, x, y, e, keep, late in zip(start.tolist(), a.tolist(), b.tolist(), end.tolist(), whole.tolist(), back.tolist(), strict=True):
                    if keep or any(0 <= raw.find(m, s, e) for m in (pre, suf, mid)):
                        forms.append("plain")
                        out.append(raw[s:e])
                    elif late:
                        forms.append("spm")
                        out.append(b"".join((suf, raw[y:e], pre, raw[s:x], mid, raw[x:y])))
                    else:
                        forms.append("psm")
                        out.append(b"".join((pre, raw[s:x], suf, raw[y:e], mid, raw[x:y])))
                cut = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(forms, pa.string()), pa.array(chars[1] - chars[0], mask=cut), pa.array(chars[2] - chars[1], mask=cut), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of :func:`fill_in_middle` was made from."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
    ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""
