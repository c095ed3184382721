"""Column functions over text.  Lengths count code points; a null stays null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what counts as white space at the ends of a text: Unicode's spaces, not U+0020 alone
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(x: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(x, F.lit(_SPACES))


def null_if_blank(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def search_tokens(text: Column) -> Column:
    """Terms in text order: runs of [0-9a-z_] of the lower-cased text; each CJK character, then its pair with the one before.

    All else separates.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9a-z_]+|[㐀-鿿]+)"), F.lit(1))

    def expand(run: Column) -> Column:
        one = F.array(F.substring(run, 1, 1))
        rest = F.flatten(F.transform(F.sequence(F.lit(2), F.length(run)), lambda i: F.array(F.substring(run, i, F.lit(1)), F.substring(run, i - 1, F.lit(2)))))
        return F.when(run.rlike("^[0-9a-z_]"), F.array(run)).when(F.length(run) == 1, one).otherwise(F.concat(one, rest))

    # only texts with such characters pay for the expansion
    return F.when(text.rlike("[㐀-鿿]"), F.flatten(F.transform(runs, expand))).otherwise(runs)


_RUN, _CJK = re.compile("[0-9a-z_]+|[㐀-鿿]+"), re.compile("[㐀-鿿]")


def terms_of(text: str | None) -> list[str]:
    """:func:`search_tokens` of one text, for tasks that count terms in Python anyway: far faster than the column."""
    runs = _RUN.findall((text or "").lower())
    if not text or text.isascii() or not _CJK.search(text):
        return runs
    return [t for r in runs for t in ([r] if r.isascii() else [r[0], *(x for i in range(1, len(r)) for x in (r[i], r[i - 1 : i + 1]))])]


def query_terms(text: Column) -> Column:
    """Distinct terms of a question; null when it has none."""
    terms = F.array_distinct(search_tokens(text))
    return F.when(F.size(terms) > 0, terms)


def token_estimate(text: Column) -> Column:
    return (F.floor(F.length(text) / 2) + 1).cast("int")


def chunk_id(document_id: Column, index: Column, content: Column) -> Column:
    """A stable positive 63-bit id: the first 8 bytes of sha256 of ``document:index`` and the content, sign cleared, 0 made 1."""
    digest = F.sha2(F.concat(document_id.cast("string"), F.lit(":"), index.cast("string"), F.lit("\n"), content), 256)
    # both halves fit a long, so nothing overflows
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    value = F.shiftleft(high, 32).bitwiseOR(low)
    return F.when(value == 0, F.lit(1).cast("long")).otherwise(value)


def embed_text(name: Column, body: Column) -> Column:
    """What is embedded for a chunk: the document's name, a new line, the body; the body alone when the name is blank."""
    return F.when(F.coalesce(trimmed(name), F.lit("")) == "", body).otherwise(F.concat(name, F.lit("\n"), body))


def truncated(text: Column, n: int) -> Column:
    """At most ``n`` characters, with an ellipsis when cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def compact(text: Column, n: int) -> Column:
    """White space made single spaces, then cut."""
    return truncated(trimmed(F.regexp_replace(text, rf"{SPACE}+", " ")), n)


def strip_fence(raw: Column) -> Column:
    """JSON out of a fenced code block; other text is only trimmed."""
    value = trimmed(raw)
    inside = trimmed(F.regexp_replace(value, "^```", ""))
    inside = F.when(F.lower(inside).startswith("json"), trimmed(F.substring(inside, F.lit(5), F.length(inside)))).otherwise(inside)
    return F.when(value.startswith("```"), trimmed(F.regexp_replace(inside, "```$", ""))).otherwise(value)


def json_body(raw: Column) -> Column:
    """From the first brace to the last one, without blocks of model reasoning."""
    plain = F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")
    return F.regexp_extract(strip_fence(plain), r"(?s)\{.*\}", 0)


def visible(text: Column) -> Column:
    """Number of characters other than white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def invalid_chars(text: Column) -> Column:
    """Characters that show a failed decoding: replacement, control and private-use ones, and placeholders like (cid:12)."""
    marks = F.length(text) - F.length(F.regexp_replace(text, r"\(cid:\d+\)", ""))
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\ufffd\ue000-\uf8ff]|[\p{Cc}&&[^\s]]", ""))
    return marks + odd


def garbled(text: Column) -> Column:
    """Too little text (under 8 visible characters), or three tenths of it invalid."""
    return (visible(text) < 8) | (invalid_chars(text) / F.greatest(visible(text), F.lit(1)) >= 0.3)


def masked(secret: Column) -> Column:
    """Only the last four characters of a secret, and of short ones nothing."""
    key = F.coalesce(trimmed(secret), F.lit(""))
    return F.when(key == "", "").when(F.length(key) <= 4, "****").otherwise(F.concat(F.lit("****"), F.right(key, F.lit(4))))


def normal_email(address: Column) -> Column:
    """Lower-cased and trimmed; null without an @."""
    value = F.lower(trimmed(address))
    return F.when(F.contains(value, F.lit("@")), value)


def nickname(email: Column, default: str = "user") -> Column:
    """What stands before the @, at most 64 characters; ``default`` when empty."""
    name = F.substring(F.substring_index(email, "@", 1), 1, 64)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(default)).otherwise(name)


#: labels of questions and answers; a fixed value
_LABEL = r"(?iu)^\s*(?:问题|答案|回答|问|答|q|a|question|answer)\s*[:：\t ]+"


def clean_qa(field: Column) -> Column:
    """A field of a question-answer pair, trimmed, without its label."""
    return trimmed(F.regexp_replace(trimmed(field), _LABEL, ""))


# ---- headings; the patterns and words are fixed values of the templates

MARKDOWN = r"^(#{1,6})\s+(.+?)\s*$"
BOOK = r"(?iu)^(第[0-9一二三四五六七八九十百千零〇两]+[编篇卷章节回部]|chapter\s+[0-9ivxlcdm]+|part\s+[0-9ivxlcdm]+)(?:[\s　:：.、-]+.*)?$"
PAPER = (
    r"(?iu)^(?:[1-9]\d*(?:\.\d+)*[\s　.、]+.{1,80}|(?:abstract|摘要|introduction|引言|绪论|related\s+works?|相关工作|methods?|methodology|材料与方法|方法|"
    r"experiments?|实验|results?|结果|discussion|讨论|conclusions?|结论|references|参考文献|acknowledg(?:e)?ments?|致谢)[\s　:：]*)$"
)
RESUME = (
    r"(?iu)^(?:个人信息|基本信息|个人简介|个人总结|求职意向|教育(?:背景|经历)|工作经历|实习经历|项目经历|技能(?:清单|特长)?|专业技能|证书|获奖经历|校园经历|自我评价|联系方式|"
    r"profile|summary|objective|education|work\s+experience|employment|experience|projects?|skills?|certificates?|awards?)[\s　:：]*$"
)


def heading(line: Column, template: str = "general", element_type: Column | None = None) -> Column:
    """struct(level, title) of a heading line, null for other lines.

    ``template``: general, book, paper or resume.  A marked title is of level 1.  Other lines of more than 100 characters
    are no headings.
    """
    text = trimmed(line)
    kind = element_type if element_type is not None else F.lit("")
    got = lambda level, title: F.struct(level.cast("int").alias("level"), title.alias("title"))
    marks = F.regexp_extract(text, MARKDOWN, 1)
    out = F.when(text.rlike(MARKDOWN), got(F.length(marks), trimmed(F.regexp_extract(text, MARKDOWN, 2))))
    out = out.when(kind.isin("title", "section_header"), got(F.lit(1), trimmed(F.regexp_replace(text, "^[# ]+", ""))))
    out = out.when(F.length(text) > 100, F.lit(None))
    if template == "book":
        out = out.when(text.rlike(BOOK), got(F.when(F.contains(text, F.lit("节")), 2).otherwise(1), text))
    elif template == "paper":
        number = F.regexp_replace(F.regexp_extract(text, r"^(\S+)", 1), "[.、]+$", "")
        depth = F.when(number.rlike(r"^\d+(\.\d+)*$"), F.least(F.size(F.split(number, r"\.")), F.lit(6))).otherwise(1)
        out = out.when(text.rlike(PAPER), got(depth, text))
    elif template == "resume":
        out = out.when(text.rlike(RESUME), got(F.lit(1), F.regexp_replace(text, "[ :：]+$", "")))
    return out


#: extension -> (media type, kind of preview); fixed values
MEDIA = {
    "pdf": ("application/pdf", "pdf"), "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx"), "md": ("text/markdown", "markdown"), "markdown": ("text/markdown", "markdown"),
    "txt": ("text/plain", "text"), "csv": ("text/csv", "csv"), "png": ("image/png", "image"), "jpg": ("image/jpeg", "image"), "jpeg": ("image/jpeg", "image"), "webp": ("image/webp", "image"), "gif": ("image/gif", "image"),
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def media_type(name: Column) -> Column:
    found = F.create_map(*[F.lit(x) for k, (m, _) in MEDIA.items() for x in (k, m)])
    return F.coalesce(F.try_element_at(found, extension(name)), F.lit("application/octet-stream"))


def preview_kind(name: Column) -> Column:
    found = F.create_map(*[F.lit(x) for k, (_, p) in MEDIA.items() for x in (k, p)])
    return F.coalesce(F.try_element_at(found, extension(name)), F.lit("unsupported"))


def progress(status: Column, done: Column, total: Column) -> Column:
    """Percent of a document's way: 10 parsing, 40 chunking, 60 to 95 embedding, 100 done."""
    part = F.when(total > 0, F.floor(F.lit(35) * done / total)).otherwise(0)
    return F.when(status == "parsing", 10).when(status == "chunking", 40).when(status == "embedding", 60 + part).when(status == "done", 100).otherwise(0).cast("int")


def backoff(attempt: Column, cap: int = 60) -> Column:
    """Seconds to wait before the next try: 1, 2, 4, ... at most ``cap``."""
    return F.least(F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), F.lit(float(cap))).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null where a norm is 0 or the sizes differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))
