"""Main text of web pages by nearest-URL page differencing (operator 8).

A page is cut into blocks of text, each known to stand in the article, in marked boilerplate (menus, footers, adverts,
...) or neither.  Within a host, pages are put in order of their URL path, and each is paired with the neighbour whose
path shares the longest beginning.  The blocks of the two are aligned by longest common subsequence; shared blocks
belong to the site, not the page, and are deleted.  What an element marks as the article needs more evidence, as pages may
well carry one story or quote one passage: such a block goes only if both neighbours share it and it stands in the articles
of at least half of the host's pages.  A neighbour that shares half of the article's blocks carries the same story and says nothing about the site; no block of the article goes then.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/][^<>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split()
)
_DROP = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea dialog menu title".split())
_ARTICLE = frozenset(["article", "main"])
#: words of class and id that mark what is not the article
_MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments replies responses disqus related recommended share sharing social newsletter subscribe signup login widget toolbar pagination pager skip".split()
)
#: these only outside the article
_OUTER = frozenset("header footer masthead topbar copyright".split())
#: words that say where or how something stands, not what it is
_NEUTRAL = frozenset("area articles author bar block bottom box button buttons container content inner item items left link links list main outer page panel posts reader readers right section site slot stories top unit wrap wrapper".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())


def _marked(name: str, inside: bool) -> bool:
    """Whether a class or id marks boilerplate.  In the article all of its words must, so that related-work is none."""
    found = set(re.findall("[a-z]+", name))
    if inside:
        return bool(found & _MARKS) and found <= _MARKS | _NEUTRAL
    return bool(found & (_MARKS | _OUTER))


def _dropped(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _DROP or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next(filter(None, values), "").lower()
        if name in ("class", "id"):
            if any(_marked(x, inside) for x in value.split()):
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in _ROLES):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


ARTICLE, PLAIN, BOILERPLATE = 0, 1, 2


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, kind) of each block in page order; references are decoded, white space is one space, empty blocks are left out."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # (tag, dropped, in article)
    open_ = Counter()
    dropped = inside = False

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, BOILERPLATE if dropped else ARTICLE if inside else PLAIN))

    def close(k: int) -> None:
        open_.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def pop(k: int) -> None:
        nonlocal dropped, inside
        flush()
        close(k)
        dropped, inside = stack[-1][1:] if stack else (False, False)

    at = 0
    last = html.rfind(">")  # beyond it there is no tag to look for
    while at <= last and (m := _TAG.search(html, at)):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        closing, tag, attrs = m[1], (m[2] or "").lower(), m[3] or ""
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1) if open_[tag] > 0 else ():
                if stack[k][0] == tag:
                    # inline tags only matter to the stack
                    if tag in _BLOCK or any(x[1] != dropped or x[2] != inside for x in stack[: k or 1][-1:]) or not k:
                        pop(k)
                    else:
                        close(k)
                    break
            else:
                if tag in _BLOCK:
                    flush()
            continue
        if tag in _BLOCK:
            flush()
            if stack and tag != "li":
                for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                    if stack[k][0] == "p":  # a block ends an open paragraph
                        pop(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
            elif stack and stack[-1][0] == "li":
                pop(len(stack) - 1)
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if tag in _RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in _VOID or attrs.endswith("/"):
            continue
        out_here = dropped or _dropped(tag, attrs, inside)
        if out_here != dropped or tag in _ARTICLE:
            flush()
        dropped, inside = out_here, inside or tag in _ARTICLE
        stack.append((tag, dropped, inside))
        open_[tag] += 1
    if at < len(html):
        cut_off = re.search(r"<[a-zA-Z/!?]", html[max(at, last + 1) :])  # a tag cut off at the end is not text
        parts.append(html[at : max(at, last + 1) + cut_off.start()] if cut_off else html[at:])
    flush()
    return out


def shared(a: list[int], b: list[int]) -> set[int]:
    """Indexes of ``a`` on a longest common subsequence with ``b``.

    A row of the table of lengths is a bit vector, whose zeros are the places where the length grows, and follows from the
    row before by an addition; so the time is len(a) * len(b) / 64, whatever repeats.  Every 256th row is kept, the others
    are made again on the way back.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = {*range(low), *range(len(a) - high, len(a))}
    b = b[low : len(b) - high]
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    rows = [i for i in range(low, len(a) - high) if a[i] in where]
    mask, step = (1 << len(b)) - 1, 256

    def after(v: int, i: int) -> int:
        u = v & where[a[i]]
        return (v + u | v - u) & mask

    kept = [mask]
    v = mask
    for k, i in enumerate(rows, 1):
        v = after(v, i)
        if k % step == 0:
            kept.append(v)
    left = mask  # the places of b that may still be met
    for s in range(len(kept) - 1, -1, -1):
        some = rows[s * step : (s + 1) * step]
        table_ = [kept[s]]
        for i in some:
            table_.append(after(table_[-1], i))
        for k in range(len(some), 0, -1):
            zeros = ~table_[k] & left
            if zeros.bit_count() > (~table_[k - 1] & left).bit_count():
                out.add(some[k - 1])
                left = (1 << zeros.bit_length() - 1) - 1
    return out


_PARSED = "_key long, url string, host string, path string, kinds array<int>, prints array<long>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each page stands, and of its blocks only their kind and a hash."""
    import xxhash

    for batch in batches:
        for lo in range(0, len(batch), 64):
            part = batch.slice(lo, 64)
            found = [blocks(h or "") for h in part.column("html").to_pylist()]
            hosts, paths = [], []
            for url in part.column("url").to_pylist():
                m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", url or "", re.S)
                hosts.append(m[1].lower())
                paths.append(m[2] or "/")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_key"), part.column("url"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array([[k for _, k in x] for x in found], pa.list_(pa.int32())),
                    pa.array([[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in x] for x in found], pa.list_(pa.int64())),
                ],
                ["_key", "url", "host", "path", "kinds", "prints"],
            )


def _common(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def lost(prints: list[int], kinds: list[int], nearest: list[int] | None, other: list[int] | None, common: set[int] | None = None) -> list[int]:
    """Places of the blocks that belong to the site, by the blocks of the nearest page and of the other neighbour; of the article's blocks those that both share and that are in ``common``, if it is given."""
    near, far = (shared(prints, x) if x else set() for x in (nearest, other))
    gone = {i for i in near if kinds[i] == PLAIN}
    article = {i for i, k in enumerate(kinds) if k == ARTICLE}
    if all(2 * len(x & article) < len(article) for x in (near, far)):
        gone |= {i for i in near & far & article if common is None or prints[i] in common}
    return sorted(gone)


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that a page shares with its neighbours and loses, for the pages that lose any."""
    for batch in batches:
        keys, gone = [], []
        for r in batch.to_pylist():
            first = _common(r["path"], r["before_path"]) >= _common(r["path"], r["after_path"])
            if places := lost(r["prints"], r["kinds"], *((r["before"], r["after"]) if first else (r["after"], r["before"])), set(r["common"] or ())):
                keys.append(r["_key"])
                gone.append(places)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["_key", "gone"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 64):
            part = batch.slice(lo, 64)
            texts = []
            for html, gone in zip(part.column("html").to_pylist(), part.column("gone").to_pylist(), strict=True):
                found = blocks(html or "")
                # in a page that marks its article, what stands outside is not part of it
                kind, gone = ARTICLE if any(k == ARTICLE for _, k in found) else PLAIN, set(gone or ())
                texts.append("\n".join(t for i, (t, k) in enumerate(found) if k == kind and i not in gone))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _common_blocks(parsed: DataFrame) -> DataFrame:
    """host, common: the blocks in the articles of at least half of a host's pages, and of three; at most twice as many as a page has."""
    pages = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    own = F.array_distinct(F.filter(F.transform("prints", lambda x, i: F.when(F.get("kinds", i) == ARTICLE, x)), lambda x: x.isNotNull()))
    often = parsed.select("host", F.explode(own).alias("_print")).groupBy("host", "_print").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").join(pages, "host")
    return cut(often.where("2 * _n >= _pages").groupBy("host").agg(F.collect_list("_print").alias("common")))


def extract(pages: DataFrame, most: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars: main text of each of ``pages`` (page_id, url, html), empty if there is none.

    Null html is empty.  Pages without a URL form a host of their own, with an empty path.  Where paths are equal the
    order goes by URL, then content.  Rows that repeat URL and html are one page in the pairing.  A page alone in its host
    has no partner and loses only marked boilerplate.  Other columns are ignored; an empty table gives an empty result.

    Texts are not moved: pairing and alignment work on hashes of the blocks, and the pages are parsed again to be
    written.  ``most``: pages that lose shared blocks up to which these are broadcast; more are joined by shuffle.
    """
    spark = pages.sparkSession
    pages = pages.select(F.xxhash64("url", "html").alias("_key"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    parsed = cut(pages.select("_key", "url", "html").mapInArrow(_parse, _PARSED).dropDuplicates(["_key"]))
    # global order by range: a host with many pages is spread over tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["host", "path", "url", "_key"]
    ordered = parsed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = cut(ordered.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    so_far = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(so_far, F.lit(0)).alias("_start"))
    ranked = ordered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    ranked = cut(ranked.select("_key", "host", "path", "kinds", "prints", "_rank"))
    other = ranked.select("_rank", "host", "path", "prints")
    me, left, right = ranked.alias("m"), other.alias("l"), other.alias("r")
    near = me.join(left, (F.col("l._rank") == F.col("m._rank") - 1) & (F.col("l.host") == F.col("m.host")), "left").join(right, (F.col("r._rank") == F.col("m._rank") + 1) & (F.col("r.host") == F.col("m.host")), "left")
    near = near.select("m._key", "m.host", "m.path", "m.kinds", "m.prints", F.col("l.path").alias("before_path"), F.col("l.prints").alias("before"), F.col("r.path").alias("after_path"), F.col("r.prints").alias("after"))
    common = _common_blocks(parsed)
    if common.count() <= most:
        common = F.broadcast(common)
    near = near.join(common, "host", "left").drop("host")
    gone = cut(near.mapInArrow(_differenced, "_key long, gone array<int>"))
    if gone.count() <= most:
        gone = F.broadcast(gone)
    out = pages.join(gone, "_key", "left").select("page_id", "url", "html", "gone").mapInArrow(_written, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
