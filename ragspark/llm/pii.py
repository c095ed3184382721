"""Information-theoretic sanitisation (operator 1).

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  Their values are the protected entities.
Words that stand near an entity are counted over the whole corpus; with U distinct texts in the corpus (near copies are
one), n(e) of them that hold entity e, n(t) that hold term t and n(t,e) that hold t near e, a term discloses the entity
to the degree  PMI(t;e) / IC(e) = log2(n(t,e) U / (n(t) n(e))) / log2(U / n(e)),  1 when seeing t gives e away.  Terms over
the lower threshold are generalised to a label, terms over the higher one removed, wherever they occur.

All of it is DataFrame functions.  Java's regular expressions scan each text in linear time: runs are possessive, and
start where the run starts or where the last match ended, which leaves the matches as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: the last are terms over the higher threshold
KINDS = ["email", "ip", "card", "phone", "term", "term"]
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without a match of these can't have a span of the kind.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
_SPAN = "array<struct<start:int,kind:int,end:int,value:string,near:string>>"
#: elements that a running total goes through one by one
_STEP = 256


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, more) -> Column:  # noqa: ANN001
    """For each of an array of whole numbers what ``more`` (sum or greatest) makes of 0 and all before it; by blocks, so that no array is copied for each element."""
    fold = lambda x, start=F.lit(0): F.aggregate(x, start, more)

    def with_blocks(v: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(_STEP))
        return _bound(F.transform(firsts, lambda b: fold(F.slice(v, b + 1, F.lit(_STEP)))), lambda sums: _bound(F.transform(sums, lambda _, j: fold(F.slice(sums, F.lit(1), j))), lambda starts: F.transform(
            v, lambda _, i: fold(F.slice(v, i - i % _STEP + 1, i % _STEP), F.get(starts, F.floor(i / _STEP).cast("int")))
        )))

    return F.when(F.size(values) > 0, _bound(values, with_blocks)).otherwise(values)


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of 10."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, d).otherwise(twice)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False),
        "phone": (n >= 10) & (n <= 15),
    }[kind]


def located(text: Column, pattern: Column, kind: int, window: int = 0) -> Column:
    """Every match with its place in code points, as what stands between the matches, and the matches, add up to it; ``near`` is what
    stands on both sides up to the next match, at most ``window`` characters."""

    def places(gaps: Column, values: Column) -> Column:
        sizes = F.transform(gaps, lambda g, i: F.length(g) + F.coalesce(F.length(F.get(values, i)), F.lit(0)))

        def place(value: Column, i: Column, starts: Column) -> Column:
            start = F.get(starts, i) + F.length(F.get(gaps, i))
            around = F.concat(F.right(F.get(gaps, i), F.lit(window)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(window)))
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"), around.alias("near"))

        return _bound(before(sizes, lambda a, x: a + x), lambda starts: F.transform(values, lambda v, i: place(v, i, starts)))

    return _bound(F.split(text, pattern, -1), lambda gaps: _bound(F.regexp_extract_all(text, pattern, F.lit(0)), lambda values: places(gaps, values)))


def base_spans(text: Column, window: int = 0) -> Column:
    """All base spans by start, then kind; of each kind the leftmost non-overlapping matches that pass its test."""

    def passing(kind: str):  # noqa: ANN202
        return lambda x: _holds(kind, x["value"])

    none = F.from_json(F.lit("[]"), _SPAN)
    found = []
    for k, kind in enumerate(KINDS[:4]):
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_HINT[kind])
        found.append(F.when(hint, F.filter(located(text, F.lit(PATTERNS[kind]), k, window), passing(kind))).otherwise(none))
    return F.array_sort(F.concat(*found))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w.rlike(r"^\p{L}{3,}$"))


#: A text's sketch: the least hash of its word pairs in each of 32 ranges of hashes; an empty range takes that of the next
#: one that isn't.  Three equal ones of a band make two texts candidates, ``_EQUAL`` equal ones of all make them near copies
#: (a Jaccard index of about a half).
_RANGES = 32
_BANDS = [(i % 32, (i * 3 + 7) % 32, (i * 5 + 18) % 32) for i in range(20)]
_EQUAL = 16


def sketched(docs: DataFrame) -> DataFrame:
    """_text (hash of the text) and its sketch ``s`` of the distinct texts of ``docs`` with two words at least.

    Hashes are sorted once, so that a range's least one is the first of it: one look at each word pair.
    """
    w = F.split(F.lower("text"), r"\s+")
    two = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i)))
    pairs = docs.select(F.xxhash64("text").alias("_text"), w.alias("w")).where(F.size("w") > 1).select("_text", F.array_sort(two).alias("h"))
    of = lambda x: F.shiftright(x, 59)  # noqa: E731  -16 to 15, in the order of the hashes
    least = F.filter("h", lambda x, i: (i == 0) | (of(x) != of(F.get("h", i - 1))))
    # for each range the first least hash of it or of a later range, else the first of all
    filled = F.transform(F.sequence(F.lit(-_RANGES // 2), F.lit(_RANGES // 2 - 1)), lambda k: F.coalesce(F.get(F.filter("m", lambda x: of(x) >= k), F.lit(0)), F.get("m", F.lit(0))))
    return pairs.select("_text", least.alias("m")).select("_text", filled.alias("s")).dropDuplicates(["_text"])


def near_copies(docs: DataFrame, most: int) -> DataFrame:
    """(_text, _group) for the hashes of texts of ``docs`` that are near copies of one with a smaller hash, which is their group's.

    Texts of a bucket are compared with its smallest only, not with each other; groups that a text joins become one.
    """
    sketches = cut(sketched(docs))
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.get("s", F.lit(i)) for i in x]) for b, x in enumerate(_BANDS)])
    bands = cut(sketches.select("_text", F.explode(bands).alias("band")))
    first = bands.groupBy("band").agg(F.min("_text").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = cut(bands.join(first, "band").where("_text <> a").select("a", F.col("_text").alias("b")).distinct())
    # a text that many are compared with is no single task's: its sketch is broadcast
    ends = edges.select("a").distinct().join(sketches, F.col("a") == F.col("_text")).select("a", F.col("s").alias("sa"))
    if edges.select("a").distinct().count() <= most:
        ends = F.broadcast(ends)
    equal = F.size(F.filter(F.zip_with("sa", "s", lambda x, y: x == y), lambda x: x))
    edges = cut(edges.join(sketches, F.col("b") == F.col("_text")).join(ends, "a").where(equal >= _EQUAL).select("a", "b"))
    label = cut(edges.select(F.col("b").alias("_text")).union(edges.select("a")).distinct().withColumn("_group", F.col("_text")))
    small = label.count() <= most
    told = F.broadcast if small else (lambda x: x)
    while True:
        ends = edges.join(told(label.select(F.col("_text").alias("a"), F.col("_group").alias("ga"))), "a").join(told(label.select(F.col("_text").alias("b"), F.col("_group").alias("gb"))), "b")
        # a group takes the smallest name among the groups that it is tied to
        names = cut(ends.where("ga <> gb").groupBy(F.greatest("ga", "gb").alias("_group")).agg(F.min(F.least("ga", "gb")).alias("_new")))
        if names.isEmpty():
            return label.where("_text <> _group")
        label = cut(label.join(told(names), "_group", "left").select("_text", F.coalesce("_new", "_group").alias("_group")))


def disclosing_terms(spans: DataFrame, docs: DataFrame, support: int, generalise: float, remove: float, most: int) -> DataFrame:
    """Terms (term, ratio, removed) whose disclosure of any entity reaches ``generalise``.

    ``spans``: kind, value, near (the words about an entity), _text (hash of the text).  Copies and near copies count as
    one text (``near_copies``).  ``support``: texts that a pair needs.  ``most``: candidate terms, and near copies, up to which
    they are broadcast; more are joined by shuffle.
    """
    groups = cut(near_copies(docs, most))
    if groups.count() <= most:
        groups = F.broadcast(groups)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(groups, "_text", "left").withColumn("_text", F.coalesce("_group", "_text")).drop("_group")

    seen = cut(grouped(spans.distinct()))
    entities = seen.groupBy("kind", "value").agg(F.count_distinct("_text").alias("n_e")).where(F.col("n_e") >= support)
    near = seen.join(entities, ["kind", "value"], "left_semi").select("kind", "value", "_text", F.explode(_words(F.col("near"))).alias("term"))
    pairs = near.groupBy("kind", "value", "term").agg(F.count_distinct("_text").alias("n_te"))
    pairs = cut(pairs.where(F.col("n_te") >= support).join(entities, ["kind", "value"]))
    terms = pairs.select("term").distinct()
    if terms.count() <= most:
        terms = F.broadcast(terms)
    hashed = grouped(docs.select(F.xxhash64("text").alias("_text"), "text"))
    holding = hashed.select("_text", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(terms, "term", "left_semi").distinct()
    occurring = holding.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = hashed.select("_text").distinct().agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("u"))
    all_ = pairs.join(occurring, "term").crossJoin(F.broadcast(total))  # one row
    n = F.greatest(F.col("n_t"), F.col("n_te"))
    ratio = F.log2(F.col("n_te") * F.col("u") / (n * F.col("n_e"))) / F.log2(F.greatest(F.col("u") / F.col("n_e"), F.lit(2.0)))
    out = all_.groupBy("term").agg(F.max(ratio).alias("ratio")).where(F.col("ratio") >= generalise)
    return out.withColumn("removed", F.col("ratio") >= remove)


def find_private(docs: DataFrame, support: int = 3, generalise: float = 0.75, remove: float = 0.9, window: int = 120, most: int = 200_000) -> DataFrame:
    """Personal data of ``docs`` (doc_id, text), one row for each input row.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_generalised, n_removed, ``found``: every span as
    struct(start, kind, end, value), ``kind`` an index of KINDS, base spans and those of disclosing terms, by start; kind 4 is a term
    to generalise, 5 one to remove; and text_hash (xxhash64 of the text).  ``sanitised`` writes the texts that follow from it.
    Null text is empty and has no span.  Null or repeated ids and repeated rows are kept as they come.  Other columns
    are ignored.  Empty table: empty result.  ``window``: characters on each side of an entity, up to the
    next one of its kind, that are near it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = [F.col("doc_id"), F.xxhash64("text").alias("_text")]
    base = cut(docs.select(*key, base_spans(F.col("text"), window).alias("base")))
    spans = base.select("_text", F.explode("base").alias("x")).select("x.kind", "x.value", "x.near", "_text")
    plain = F.transform("base", lambda x: x.dropFields("near"))
    terms = cut(disclosing_terms(spans, docs, support, generalise, remove, most))
    if terms.count() <= most:
        terms = F.broadcast(terms)
    hits = docs.select(*key, F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(terms, "term").groupBy("doc_id", "_text").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("removed"))
    hits = cut(hits.where(F.size("terms") > 0))
    if hits.count() <= most:
        hits = F.broadcast(hits)
    # letters and digits only, so the terms need no escape
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))

    def decided(x: Column) -> Column:
        return x.withField("kind", F.when(F.array_contains("removed", F.lower(x["value"])), 5).otherwise(4))

    same = F.col("h.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("h._text") == F.col("d._text"))
    extra = docs.select(*key, "text").alias("d").join(hits.alias("h"), same).select("d.doc_id", "d._text", F.transform(located(F.col("text"), pattern, 4), lambda x: decided(x).dropFields("near")).alias("extra")).dropDuplicates(["doc_id", "_text"])
    extra = cut(extra)
    if extra.count() <= most:
        extra = F.broadcast(extra)
    same = F.col("e.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("e._text") == F.col("b._text"))
    both = base.alias("b").join(extra.alias("e"), same, "left").select("b.doc_id", "b._text", plain.alias("base"), F.when(F.col("extra").isNull(), plain).otherwise(F.array_sort(F.concat(plain, F.col("extra")))).alias("found"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def n(kind: int, spans: str = "base") -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    return both.select(
        "doc_id", *[n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])], F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("found").alias("spans"), n(4, "found").alias("n_generalised"), n(5, "found").alias("n_removed"), "found", F.col("_text").alias("text_hash"),
    )


def rewritten(text: Column, found: Column) -> Column:
    """The text with base spans replaced by their labels, terms to generalise by [TERM] and terms to remove by nothing.

    Spans that overlap are one, up to the last one's end, with the first one's label, so nothing of them is left.
    """
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS[:4]], F.lit("[TERM]"), F.lit(""))
    # a part of the text is taken from a block, not counted from the start
    size = 4096

    def part(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / size).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.greatest(F.floor(end / size).cast("int") - first + 1, F.lit(0))), "")
        return F.substring(some, start - first * size + 1, F.greatest(end - start, F.lit(0)))

    def pieces(spans: Column, ends: Column, blocks: Column) -> Column:
        heads = F.filter(F.zip_with(spans, ends, lambda x, e: F.when(x["start"] >= e, F.struct(e.alias("e"), x["start"].alias("start"), x["kind"].alias("kind")))), lambda x: x.isNotNull())
        made = F.transform(heads, lambda x: F.concat(part(blocks, x["e"], x["start"]), F.get(labels, x["kind"])))
        last = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
        return F.concat(F.array_join(made, ""), part(blocks, last, F.length(text)))

    blocks = F.transform(F.sequence(F.lit(0), F.length(text), F.lit(size)), lambda i: F.substring(text, i + 1, F.lit(size)))
    ends = before(F.transform(found, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    whole = _bound(found, lambda spans: _bound(ends, lambda e: _bound(blocks, lambda b: pieces(spans, e, b))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def sanitised(docs: DataFrame, found: DataFrame, most: int = 200_000) -> DataFrame:
    """``docs`` (doc_id, text) with ``sanitised``, their text rewritten by ``find_private``'s ``found``."""
    some = found.where(F.size("found") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "found").dropDuplicates(["_id", "_hash"])
    some = cut(some)
    if some.count() <= most:
        some = F.broadcast(some)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    text = F.coalesce("text", F.lit(""))
    return docs.join(some, same, "left").select(*[docs[c] for c in docs.columns], F.coalesce(rewritten(text, F.col("found")), text).alias("sanitised"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents")).drop("found", "text_hash")
