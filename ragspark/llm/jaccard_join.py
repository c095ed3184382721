"""Jaccard join of word shingles with prefixes of token combinations (operator 9).

Shingles are ordered by how frequent they are, rare ones first, and dealt to classes: the rare ones are one class of
single tokens, the frequent ones fall by hash into groups whose 2-token (the most frequent: 3-token) combinations are
signatures.  Two sets whose Jaccard similarity is at least 4/5 differ from their common part in at most a fifth of each.
A class of p tokens and combinations of k loses all of them only with p - k + 1 of its tokens; a set's prefix is extended
until its classes together withstand the loss of a fifth of the set.  Of two similar sets, all tokens of the shorter
prefix that both have are in the longer one, and a class is left in which they share a combination.  The number of
groups goes by the size band (powers of 2) of the set, so that a group holds a few tokens of a prefix at any size and the
combinations stay in proportion to the set; a set whose larger partners may be in the next band signs there too.

Rows with equal sets are one class from the start.  The rest goes from signatures to verified links in rounds: in each
group of a signature all sets are compared with its first one only; sets that are then known to be connected need no
further comparison.  In groups that still hold sets of different components all are compared with a bounded number of
them (``SMALL``).  What is left of larger groups goes through the same steps again by itself, where what its sets share is
more frequent than in the whole corpus and stands last; should that no longer shrink them, or are they not much larger,
they are compared with so many more of their sets in each round.  No link between different components is missed, and no group is paired with itself as a whole.  Before texts are
compared, parity bitmaps of the sets rule out pairs: bits that differ are a lower bound of the shingles that differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, cut, grams, mix, signed, table, text_slices, words

SHINGLE = 5
#: tokens of a combination: 2 for frequent shingles, 3 for those in a twentieth of all documents
CLASSES = (2, 3)
COMMON = 0.05
#: most frequent shingles that are told apart from the rare ones (a broadcast of at most 16 MB); which ones are changes no result
MOST_FREQUENT = 1_000_000
_STRETCH = 1 << 22
#: sets of a signature's group, about, that the others are compared with in a round
SMALL = 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, end of each row's set among them): sorted distinct shingles of each row."""
    h, _, _, counts = words(data, offsets, SPACED)
    row = np.repeat(np.arange(len(counts)), counts)
    g = grams(h, SHINGLE)
    own = row[: len(g)]
    whole = own == row[SHINGLE - 1 : SHINGLE - 1 + len(g)] if len(g) else own.astype(bool)
    g, own = g[whole], own[whole]
    # a text of fewer words is one shingle
    first = np.append(0, np.cumsum(counts))
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        short = np.array([_sequence(h[first[r] : first[r] + counts[r]]) for r in few], np.uint64)
        g, own = np.concatenate([g, short]), np.concatenate([own, few])
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    g, own = g[new], own[new]
    return g, np.searchsorted(own, np.arange(len(counts)), side="right")


def _sequence(h: np.ndarray) -> np.uint64:
    x = np.array([len(h)], np.uint64)
    for w in h:
        x = mix(x * np.uint64(0x5851F42D4C957F2D) + w)
    return x[0]


def _set_ids(g: np.ndarray, ends: np.ndarray, renamed: dict[tuple[int, int], int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a 128-bit digest of each set.  The first is its name, but for those in ``renamed``."""
    starts = np.append(0, ends[:-1])
    both = np.zeros((len(ends), 2), np.int64)
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        if b > a:
            both[i] = np.frombuffer(hashlib.blake2b(g[a:b].tobytes(), digest_size=16).digest(), "<i8")
            if renamed and (name := renamed.get(tuple(both[i].tolist()))) is not None:
                both[i, 0] = name
    return both[:, 0], both[:, 1]


# ---------------------------------------------------------------- pass 1: sets and classes

_SETS = "doc_id long, text_hash long, n long, sid long, check long, bits binary, token long, times long"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("token", pa.int64()), ("times", pa.int64())])


def bitmap(own: np.ndarray) -> bytes:
    """Parity of the shingles in each of 256, 512, ... places, as many as shingles at least."""
    m = 256
    while m < len(own):
        m *= 2
    return np.packbits(np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles that only one of two sets has; the longer bitmap is folded to the other's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def _again(held: list[np.ndarray]) -> pa.RecordBatch:
    """Shingles that come up at least three times among the sets held."""
    token, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    token, times = token[times >= 3], times[times >= 3]
    k = len(token)
    none = pa.nulls(k, pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(k, pa.binary()), signed(token), pa.array(times)], schema=_SETS_ARROW)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (its set's size, id and bitmap), and rows of shingles that repeat within a stretch of documents."""
    held: list[np.ndarray] = []
    size, seen = 0, set()
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            g, ends = shingle_sets(data, offsets)
            starts = np.append(0, ends[:-1])
            ids, checks = _set_ids(g, ends)
            k = hi - lo
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[lo:hi], batch.column("text_hash")[lo:hi], pa.array(ends - starts), pa.array(ids), pa.array(checks),
                    pa.array([bitmap(g[a:b]) if b > a else None for a, b in zip(starts, ends, strict=True)], pa.binary()), none, none,
                ],
                schema=_SETS_ARROW,
            )
            for a, b, i in zip(starts, ends, ids.tolist(), strict=True):
                if i not in seen:  # copies count once
                    seen.add(i)
                    held.append(g[a:b])
                    size += b - a
            if size >= _STRETCH:
                yield _again(held)
                held, size, seen = [], 0, set()
    yield _again(held)


def _frequent(told: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens in order, their class, how frequent as a power of 2) of the most frequent shingles."""
    top = told.groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.col("times").desc(), "token").limit(MOST_FREQUENT).toArrow()
    token = top.column("token").to_numpy().view(np.uint64)
    times = top.column("times").to_numpy()
    order = np.argsort(token)
    return token[order], np.where(times >= max(3, COMMON * documents), CLASSES[1], CLASSES[0]).astype(np.int8)[order], np.log2(np.maximum(times, 1)).astype(np.int8)[order]


# ---------------------------------------------------------------- pass 2: signatures


def bands(n: int) -> list[int]:
    """Least sizes of the bands in which a set of ``n`` shingles signs: its own, and the next if a set there may be linked with it."""
    low = 1 << (n.bit_length() - 1)
    return [low, 2 * low] if 5 * n >= 8 * low else [low]


def groups_of(low: int) -> tuple[int, int, int]:
    """Numbers of groups of the classes of single tokens, 2-token and 3-token combinations in a band."""
    return 1, max(1, low // 10), max(1, low // 16)


#: places of a number of shingles, and of a place in the order, in one long
_N, _PLACE = 38, 19
_MASK = (1 << _PLACE) - 1


def signatures(own: np.ndarray, klass: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, places, first places) of one set of sorted hashes.

    Both places are that of a single token in the order.  A combination has its first token's; its other place is how many
    tokens are not in common if it is where two sets meet: the single ones (else they meet at one), and those before its
    first token in its group.  Sets of up to three shingles are linked with equal sets only and don't sign.
    """
    n = len(own)
    if n < 4:
        return own[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = n // 5 + 1
    order = np.lexsort((own, level, klass))
    own, klass = own[order], klass[order]
    single = int(np.searchsorted(klass, 1, side="right"))
    at = np.arange(min(need, single))
    out, places, first = [own[at]], [at], [at]
    for low in bands(n) if single < need else ():
        rest, kinds = own[single:], klass[single:].astype(np.int64)
        counts = np.array(groups_of(low), np.uint64)
        group = kinds * (1 << 40) + (mix(rest) % counts[kinds - 1]).astype(np.int64)
        # the place of each token in its group; those from the k-th on add to what the prefix withstands
        inside = _places(group)
        adds = np.cumsum(inside >= kinds - 1)
        end = int(np.searchsorted(adds, need - single)) + 1
        for k in CLASSES:
            mine = np.flatnonzero(kinds[:end] == k)
            pick = _chosen(group[mine], k)
            if pick.shape[1]:
                g = np.full(pick.shape[1], k * 1000003 + low, np.uint64)
                for row in pick:
                    g = mix(g * np.uint64(0x5851F42D4C957F2D) + rest[mine[row]])
                out.append(g)
                places.append(single + inside[mine[pick[0]]])
                first.append(mine[pick[0]] + single)
    return np.concatenate(out), np.concatenate(places), np.concatenate(first)


def _places(group: np.ndarray) -> np.ndarray:
    """How many before each one are of its group."""
    order = np.argsort(group, kind="stable")
    new = np.flatnonzero(np.diff(group[order], prepend=-1))
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
    return out


def _chosen(group: np.ndarray, k: int) -> np.ndarray:
    """Places of all combinations of ``k`` of one group, in order, as columns."""
    order = np.argsort(group, kind="stable")
    end = np.searchsorted(group[order], group[order], side="right")  # of each one's group
    pick = np.arange(len(group))[None]
    for _ in range(k - 1):
        after = end[pick[-1]] - 1 - pick[-1]
        new = np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
        pick = np.repeat(pick, after, axis=1)
        pick = np.vstack([pick, pick[-1] + 1 + new])
    return order[pick]


def _sign(shared: object):  # noqa: ANN202
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes, levels, renamed = shared.value
        seen: set[int] = set()  # copies within the task sign once
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                g, ends = shingle_sets(data, offsets)
                klass, level = np.ones(len(g), np.int8), np.zeros(len(g), np.int8)
                if len(tokens) and len(g):
                    at = np.searchsorted(tokens, g)
                    at[at == len(tokens)] = 0
                    hit = tokens[at] == g
                    klass[hit], level[hit] = classes[at[hit]], levels[at[hit]]
                sig, sid, np_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for a, b, i in zip(np.append(0, ends[:-1]), ends, _set_ids(g, ends, renamed)[0].tolist(), strict=True):
                    if b == a or i in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(i)
                    s, p, f = signatures(g[a:b], klass[a:b], level[a:b])
                    sig.append(s)
                    sid.append(np.full(len(s), i, np.int64))
                    np_.append((int(b - a) << _N) | (np.minimum(f, _MASK) << _PLACE) | np.minimum(p, _MASK))
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(sig)), pa.array(np.concatenate(sid)), pa.array(np.concatenate(np_))], ["sig", "sid", "np"])

    return sign


def _may_link(a: str, b: str):  # noqa: ANN202
    """From sizes and places of a common signature: whether enough tokens are left for a link.

    If the signature is the first in common, no more tokens are than those beyond its place; if it is not, the pair is met
    at the first one too.
    """
    na, nb = F.shiftright(a, _N), F.shiftright(b, _N)
    left = F.least(na - F.col(a).bitwiseAND(F.lit(_MASK)), nb - F.col(b).bitwiseAND(F.lit(_MASK)))
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * left >= 4 * (na + nb))


# ---------------------------------------------------------------- verification and components


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        last: tuple[str | None, np.ndarray | None] = (None, None)
        ta, tb = batch.column("ta"), batch.column("tb")
        for i in range(len(batch)):
            x, y = ta[i].as_py(), tb[i].as_py()
            if x != last[0]:
                last = (x, _set_of(x))
            gx, gy = last[1], _set_of(y)
            both = len(np.intersect1d(gx, gy, assume_unique=True))
            keep[i] = 100 * both >= 80 * (len(gx) + len(gy) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _set_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)], np.int64))[0]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of bitmaps: parity in 256 places."""
    for batch in batches:
        folded = [np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, 4)) for x in batch.column("bits").to_pylist()]
        four = np.array(folded, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([batch.column("sid"), *[pa.array(four[:, i].copy()) for i in range(4)]], ["sid", "s0", "s1", "s2", "s3"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [9 * differing_bits(x, y) <= n + m for x, y, n, m in zip(*[batch.column(c).to_pylist() for c in ("ba", "bb", "na", "nb")], strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def possible(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that the bitmaps of ``members`` (sid, n, bits) don't rule out."""
    one = pairs.join(members.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    both = one.join(members.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
    return cut(both.mapInArrow(_possible, "a long, b long"))


def texts_of(docs: DataFrame, members: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(sid, text): one text for each of ``ids`` (sid)."""
    needed = cut(members.select("sid", "text_hash").join(ids, "sid"))
    hint = F.broadcast if needed.count() <= most else (lambda x: x)
    return cut(docs.join(hint(needed), F.xxhash64("text") == F.col("text_hash")).dropDuplicates(["sid"]).select("sid", "text"), [needed])


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar enough.  Only the texts that pairs need are moved."""
    texts = texts_of(docs, members, pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct(), most)
    with_b = pairs.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long"), [texts])


def components(links: DataFrame) -> DataFrame:
    """(sid, label): label is the smallest id of the component; only for ids in ``links`` (a, b).

    Each round gives a node the smallest label among its neighbours', then that label's own; it ends when nothing changes.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("m")).select("sid", F.least("sid", "m").alias("label")))
    while True:
        heard = edges.join(labels.select(F.col("sid").alias("b"), "label"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("label").alias("m"))
        near = labels.join(heard, "sid").select("sid", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        far = labels.select(F.col("sid").alias("label"), F.col("label").alias("far"))
        new = cut(near.join(far, "label", "left").select("sid", F.coalesce("far", "label").alias("far"), "label", "old").select("sid", F.least("far", "label").alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.drop("old")
        labels = new.drop("old")


def _named(labels: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``rows`` (sid) with the label of their component so far, which is their own name at first."""
    if labels is None:
        return rows.withColumn("label", F.col("sid"))
    return rows.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (sig, sid, np, label) whose signature has more than one component, with the number of such rows."""
    many = rows.groupBy("sig").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("size")).where("_lo <> _hi").select("sig", "size")
    return cut(rows.join(many, "sig"))


class _Links:
    """The links found so far among the sets of ``docs``, and the components that they make."""

    def __init__(self, docs: DataFrame, members: DataFrame, most: int):
        self.docs, self.members, self.most = docs, members, most
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.round = 0

    def test(self, pairs: DataFrame) -> None:
        """Add those of ``pairs`` (a, b) that are similar."""
        near = possible(pairs, self.members)
        if near.isEmpty():
            return
        new = verified(near, self.docs, self.members, self.most)
        self.links = new if self.links is None else cut(self.links.unionByName(new))
        self.labels = components(self.links)

    def with_first(self, groups: DataFrame) -> DataFrame:
        """Compare the sets of each group (sig, sid, np) with its first one, the one with the fewest rarer shingles, which of
        near copies is the one that the others were made of.  Returns what is left of groups with several components."""
        place = F.shiftright("np", _PLACE).bitwiseAND(F.lit(_MASK))
        # of equal places the smallest name, so that groups of the same sets have the same first one
        order = F.shiftleft(place, 44).bitwiseOR(F.shiftrightunsigned("sid", 20))
        first = groups.groupBy("sig").agg(F.min_by("sid", order).alias("first"), F.min_by("np", order).alias("first_np"))
        told = groups.join(first, "sig").where("sid <> first")
        near = told.where(_may_link("np", "first_np")).select(F.col("first").alias("a"), F.col("sid").alias("b")).distinct()
        self.test(near)
        return _mixed(_named(self.labels, told.select("sig", "sid", "np")))

    def with_some(self, groups: DataFrame, n: int) -> DataFrame:
        """Compare the sets of each group (sig, sid, np, label, size) with about ``n`` of them, in groups of up to ``n`` with all, of other components.

        Which sets are compared with goes by a hash that each round draws anew, so that no group is ordered or counted in
        one task.  Sketches rule out pairs within the join.  Returns what is left of larger groups.
        """
        self.round += 1
        turn = F.shiftrightunsigned(F.xxhash64("sid", F.lit(self.round)), 1)
        chosen = (F.col("size") <= n) | (turn < (F.lit(2.0**63 * n) / F.col("size")).cast("long"))
        sketches = self.members.join(groups.select("sid").distinct(), "sid").select("sid", "bits").mapInArrow(_folded, "sid long, s0 long, s1 long, s2 long, s3 long")
        told = cut(groups.select("sig", "sid", "np", "label", chosen.alias("chosen")).join(sketches, "sid"))
        x, y = told.where("chosen").alias("x"), told.alias("y")
        differ = sum(F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(4))
        once = ~F.col("y.chosen") | (F.col("x.sid") < F.col("y.sid"))
        close = _may_link("x.np", "y.np") & (9 * differ <= F.shiftright("x.np", _N) + F.shiftright("y.np", _N))
        pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") != F.col("y.label")) & once & close)
        self.test(pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct())
        return _mixed(_named(self.labels, told.where("not chosen").select("sig", "sid", "np")))


def _signed_groups(docs: DataFrame, shared: object) -> DataFrame:
    """(sig, sid, np) of signatures that several sets have."""
    rows = cut(docs.mapInArrow(_sign(shared), "sig long, sid long, np long").where("sig is not null"))
    # most signatures come once; the others are counted before any set moves
    again = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("sig")
    return cut(rows.join(cut(again), "sig").distinct(), [rows])


def find_links(docs: DataFrame, described: DataFrame, members: DataFrame, renamed: dict, most: int, small: int) -> _Links:
    """All links that connect different sets of ``docs`` (text) into components."""
    spark = docs.sparkSession
    found, texts, before = _Links(docs, members, most), docs, None
    while True:
        counted = described.where("token is not null").select("token", "times")
        size = described.where("n is not null").count()
        groups = _signed_groups(texts, spark.sparkContext.broadcast((*_frequent(counted, size), renamed)))
        left = found.with_some(found.with_first(groups), small)
        ids = cut(left.select("sid").distinct())
        n, largest = ids.count(), left.agg(F.max("size")).first()[0] or 0
        if largest <= 4 * small or (before is not None and 2 * n > before):
            while not left.isEmpty():
                left = found.with_some(left, small)
            return found
        before, texts = n, texts_of(docs, members, ids, most)
        described = cut(texts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), "text").mapInArrow(_describe, _SETS))


def link(docs: DataFrame, most: int = 1_000_000, small: int = SMALL) -> DataFrame:
    """Components of near copies among ``docs`` (doc_id, text); one row for each input row.

    Returns doc_id, n_shingles, component_id, n_copies, text_hash (xxhash64 of the text).  Texts without words, null or empty, have no shingle and are
    linked with nothing; their component is their own id.  component_id is the smallest id that links reach.  A row
    without id is linked through by others and gets the component's smallest id, null if there is none.  ``n_copies``:
    rows with the very same set besides this one.  Repeated rows are rows with equal sets.  Other columns are ignored;
    an empty table gives an empty result.  ``most``: ids up to which those that need verification are broadcast;
    ``small``: see ``SMALL``.  Sets are told apart by 128-bit digests of 64-bit hashes of their shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = cut(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_describe, _SETS))
    sets = described.where("n is not null").select("doc_id", "text_hash", "n", "sid", "check", "bits")
    total = sets.count()
    members = sets.where("n > 0").groupBy("sid", "check").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("copies"))
    members = cut(members)
    # different sets of one name, as good as never: all but the first get another
    twice = members.groupBy("sid").agg(F.count(F.lit(1)).alias("_n"), F.min("check").alias("_first")).where("_n > 1").select("sid", "_first")
    renamed = {(r.sid, r.check): int(mix(np.array([r.check], np.int64).view(np.uint64)).view(np.int64)[0]) for r in members.join(twice, "sid").where("check <> _first").collect()}
    if renamed:
        names = docs.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "sid long, check long, _name long")
        new = lambda df: df.join(F.broadcast(names), ["sid", "check"], "left").withColumn("sid", F.coalesce("_name", "sid")).drop("_name")
        members, sets = cut(new(members)), new(sets)
    labels = find_links(docs, described, members, renamed, most, small).labels
    tagged = cut(_named(labels, members.select("sid", "least", "copies")))
    roots = tagged.groupBy("label").agg(F.min("least").alias("component_id"))
    named = tagged.join(roots, "label").select("sid", "component_id", "copies")
    # sets with a thousandth of all rows, at most a thousand, are spread over salts
    hot = F.broadcast(members.where(F.col("copies") * 1000 >= total).select("sid", F.lit(True).alias("_hot")))
    none = F.lit(0)
    wide = named.join(hot, "sid", "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(none, F.lit(31))).otherwise(F.array(none)))).drop("_hot")
    salt = F.when(F.col("_hot") | (F.col("n") == 0), F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int")).otherwise(none)
    out = sets.join(hot, "sid", "left").withColumn("_salt", salt).join(wide, ["sid", "_salt"], "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1).cast("long").alias("n_copies"), "text_hash",
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).drop("n_copies", "text_hash")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g FROM w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
 reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, root FROM reach JOIN l ON l.a = reach.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
