"""Language-model scoring with a hierarchical Pitman-Yor model (operator 10).

A restaurant for each word that another follows, and one without context that is their common parent; below it the
uniform distribution over the vocabulary and one unknown word.  A token after a word is a customer of that word's
restaurant; each of its tables is a customer of the parent.  The first tokens of texts are customers of the parent itself.

What the model gathers grows with the corpus.  Tokens are dealt to buckets by the word before them (a word that would
fill much of a bucket is split into parts by the word after it), as one row of arrays for each bucket and about a million
tokens, so that a restaurant is whole in one group.  A pair of one customer has one table; the others, the parties, are
seated by Gibbs sampling: in a sweep each party of a restaurant draws its number of tables from its conditional
distribution given the others (generalised Stirling numbers) up to 64 customers; larger parties are seated one after
another by the Chinese-restaurant rule, in leaps of a sixteenth of those already seated.  All restaurants are seated at
once, given the parent; then the parent is, given the tables sent up.  The parties of a restaurant are dealt to 8 rounds,
and those of one round don't see each other's draws.  Words under a millionth of all tokens have their mean as base
probability while restaurants are seated, their own when texts are scored.  Random numbers are hashes of context, word
and sweep, so results don't depend on how rows are dealt.

Predictive probabilities of the kept passes are averaged.  Discounts are estimated from the numbers of pairs (words) that
come once and twice; they and the strength are not sampled.

To score, each token is dealt to its restaurant's bucket with its text's key; pairs that the corpus has once are found
there by counting again, so they need no table.  Pairs with a millionth of all tokens are scored where they are read.
Rare words meet their parent probability in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, Places, argsort, cut, fold_of, mix, signed, table, text_slices, unique, words

END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: words and pairs with this share of all training tokens, a million at most, are known to every task
FREQUENT = 1e-6
#: training tokens of a bucket, about
BUCKET = 1 << 19
#: tokens, and texts, that a task deals to buckets at a time
_HELD, _TEXTS = 3 << 18, 1 << 14
_EXACT, _ROUNDS = 64, 8


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the token before or 0, row) of all tokens; every row ends with END."""
    h, _, _, counts = words(data, offsets, SPACED)
    ends = np.cumsum(counts)
    h = np.insert(h, ends, END)
    row = np.repeat(np.arange(len(counts)), counts + 1)
    before = np.zeros(len(h), np.uint64)
    before[1:] = np.where(row[1:] == row[:-1], h[:-1], np.uint64(0))
    return h, before, row


class _Counts:
    """Counts by key, merged whenever they reach ``most`` entries, so a task holds no more than that."""

    def __init__(self, most: int = 1 << 19):
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.size, self.most = 0, most

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.n.append(n)
        self.size += len(k)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, order, first = unique(np.concatenate(self.keys))
        n = np.add.reduceat(np.concatenate(self.n)[order], first) if len(k) else np.zeros(0, np.int64)
        self.keys, self.n, self.size = [k], [n], len(k)
        return k, n

    def full(self) -> bool:
        if self.size > 2 * self.most:
            self.merged()
        return self.size > self.most

    def clear(self) -> None:
        self.keys, self.n, self.size = [], [], 0


def _rows(columns: list[np.ndarray], names: list[str], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Small batches: what is on its way to the JVM stays bounded too."""
    for lo in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([signed(c[lo : lo + most]) if c.dtype == np.uint64 else pa.array(c[lo : lo + most]) for c in columns], names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = _Counts()
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column("text")):
            c.add(tokens(data, offsets)[0])
            if c.full():
                k, n = c.merged()
                c.clear()
                yield from _rows([k, n], ["h", "c"])
    k, n = c.merged()
    c.clear()
    yield from _rows([k, n], ["h", "c"])


def _pair(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x5851F42D4C957F2D) + g + np.uint64(1))


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``sizes``, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Deal:
    """Which part of a restaurant a token belongs to, and its bucket.  ``words`` are the frequent ones, sorted, with ``counts``."""

    def __init__(self, words_: np.ndarray, counts: np.ndarray, total: int, buckets: int):
        self.words, self.counts, self.buckets = words_, counts, buckets
        self.places = Places(words_)
        # a part has about a quarter of a bucket's tokens
        self.parts = np.maximum(1, -(-4 * buckets * counts // max(1, total)))
        hot = np.flatnonzero(self.parts > 1)
        owner = np.repeat(hot, self.parts[hot])
        part = self._named(words_[owner], _ranges(self.parts[hot]).astype(np.uint64))
        order = np.argsort(part)
        #: parts of split restaurants, sorted, and the restaurant of each
        self.hot, self.owner = part[order], owner[order]
        self.hot_places = Places(self.hot)

    @staticmethod
    def _named(g: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix(g + salt * np.uint64(0xD6E8FEB86659FD93))

    def part_of(self, g: np.ndarray, h: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """``place``: of each of ``g`` in ``words``, if that is known."""
        i = self.places.find(g) if place is None else place
        salt = np.zeros(len(g), np.uint64)
        if len(self.hot):
            on = np.flatnonzero((i >= 0) & (self.parts[i] > 1))
            salt[on] = mix(h[on]) % self.parts[i[on]].astype(np.uint64)
        return self._named(g, salt)

    def bucket_of(self, part: np.ndarray) -> np.ndarray:
        """By the part's order, so that what is sorted by part is sorted by bucket."""
        return ((part >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def rows(self, part: np.ndarray, h: np.ndarray, place: np.ndarray, other: np.ndarray, key: int = 0) -> pa.RecordBatch:
        """A row for each bucket of tokens that are sorted by part: parts, the numbers of frequent and of rare words in each, these words (as
        places in ``words``, or hashes), and ``other`` of each word."""
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        first = np.flatnonzero(new)
        often = np.flatnonzero(place >= 0)
        rare = np.flatnonzero(place < 0)
        # how many frequent and rare words there are before each part
        before = [np.searchsorted(x, np.append(first, len(part))) for x in (often, rare)]
        ids, starts = np.unique(self.bucket_of(part[first]), return_index=True)
        lists = [(part[first].view(np.int64), starts), *[(np.diff(n).astype(np.int32), starts) for n in before]]
        for x, m, n in ((place.astype(np.int32), often, before[0]), (h.view(np.int64), rare, before[1]), (other, often, before[0]), (other, rare, before[1])):
            lists.append((x[m], n[starts]))
        arrays = [pa.ListArray.from_arrays(pa.array(np.append(s, len(x)).astype(np.int32)), pa.array(x)) for x, s in lists]
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.full(len(ids), key, np.int64)), *arrays], _DEALT)

    def read(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(part, word, its place in ``words`` or -1, other, number of row) of all tokens of ``rows``."""
        out = []
        for i in range(len(t)):
            part, often, rare, f, r, of, or_ = (_list(t.column(c)[i]) for c in _DEALT[2:])
            for n, w, place, o in ((often, self.words[f] if len(f) else np.zeros(0, np.uint64), f, of), (rare, r.view(np.uint64), np.full(len(r), -1, np.int32), or_)):
                out.append((np.repeat(part.view(np.uint64), n), w, place, o.astype(np.int64), np.full(len(w), i)))
        none = np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, *[none.astype(np.int64)] * 3)


def _list(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False)


_DEALT = ["bucket", "key", "part", "often", "rare", "f", "r", "of", "or"]
_DEALT_SQL = "bucket int, key long, part array<long>, often array<int>, rare array<int>, f array<int>, r array<long>, of array<{0}>, `or` array<{0}>"


def _deal_pairs(shared: object):  # noqa: ANN202
    """Tokens by the token before them, counted within about a million tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal: Deal = shared.value
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, place, part = (np.concatenate(x) for x in zip(*held, strict=True))
            # runs of equal pairs; one that comes in two of them, as its hash is another's too, is summed later
            order = argsort(_pair(h, part))
            h, part = h[order], part[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(h))).astype(np.int32)
            by = argsort(part[first])
            at = first[by]
            return deal.rows(part[at], h[at], place[order[at]], count[by])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                h, before, _ = tokens(data, offsets)
                place = deal.places.find(h)
                on = np.flatnonzero(before != 0)
                if len(on):
                    held.append((h[on], place[on].astype(np.int32), deal.part_of(before[on], h[on], place[on - 1])))
                size += len(on)
                if size > _HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


#: a row for each bucket: parts with customers, pairs of one customer and parties; the parties' words, customers, tables now and in all
#: kept passes; and each part's tables in each kept pass
_REST = ["bucket", "part", "customers", "single", "n", "h", "c", "t", "sum"]
_REST_SQL = "bucket int, part array<long>, customers array<long>, single array<int>, n array<int>, h array<long>, c array<long>, t array<int>, sum array<long>, kept array<array<long>>"


def _restaurants(shared: object):  # noqa: ANN202
    def run(t: pa.Table) -> pa.Table:
        part, h, _, c, _ = shared.value.read(t)
        order = argsort(h)
        order = order[argsort(part[order])]
        part, h, c = part[order], h[order], c[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        c = np.add.reduceat(c, np.flatnonzero(new))
        part, h = part[new], h[new]
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        of, at = part[new], np.cumsum(new) - 1
        party = c > 1
        count = lambda m: np.bincount(at[m], minlength=len(of)).astype(np.int32)
        customers = np.bincount(at, c, len(of)).astype(np.int64)
        h, c = h[party], c[party]
        lists = [of.view(np.int64), customers, count(~party), count(party), h.view(np.int64), c, np.ones(len(c), np.int32), np.zeros(len(c), np.int64)]
        return pa.Table.from_batches([_bucket_row(t.column("bucket")[0].as_py(), lists, np.zeros((0, len(of)), np.int64))])

    return run


_long, _int = pa.list_(pa.int64()), pa.list_(pa.int32())
_REST_ARROW = pa.schema(list(zip([*_REST, "kept"], [pa.int32(), _long, _long, _int, _int, _long, _long, _int, _long, pa.list_(_long)], strict=True)))


def _bucket_row(bucket: int, lists: list[np.ndarray], kept: np.ndarray) -> pa.RecordBatch:
    """The row of a bucket; ``kept``: tables by kept pass and part."""
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    passes = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * kept.shape[1]), pa.array(kept.ravel().astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[one(pa.array(x)) for x in lists], one(passes)], schema=_REST_ARROW)


def _kept(x: pa.ListScalar, parts: int) -> np.ndarray:
    """Tables by kept pass and part."""
    return x.values.flatten().to_numpy().reshape(-1, parts) if len(x.values) else np.zeros((0, parts), np.int64)


# ---------------------------------------------------------------- the sampler


def _log_stirling(d: float, n: int = _EXACT) -> np.ndarray:
    s = np.full((n + 1, n + 2), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, n):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)) + s[c, t], -np.inf)
        s[c + 1, t] = np.logaddexp(s[c, t - 1], stay)
    return s


def _over_one(s: np.ndarray) -> np.ndarray:
    """Stirling numbers over that of one table, by tables (from one) and customers; 0 for more tables than customers."""
    with np.errstate(invalid="ignore"):
        return np.exp(s[:, 1:] - s[:, 1:2]).T


def _draw_few(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, s: np.ndarray, over: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes with ``_EXACT`` customers at most; ``c`` is sorted."""
    most = int(c[-1])
    share = np.ones((most, len(c)))
    with np.errstate(over="ignore", invalid="ignore"):
        # weights over that of one table
        np.multiply(d * base, np.arange(1, most)[:, None], out=share[1:])
        share[1:] += (theta + d * others) * base
        np.cumprod(share, axis=0, out=share)
        share *= over[:most, most, None] if c[0] == most else over[:most][:, c]
        np.cumsum(share, axis=0, out=share)
        t = 1 + np.count_nonzero(share < u * share[-1], axis=0)
    large = np.flatnonzero(~np.isfinite(share[-1]))
    if len(large):
        weight = s[c[large], 1 : most + 1].T + np.cumsum(np.log(theta + d * (others[large] + np.arange(most)[:, None])) + np.log(base[large]), axis=0)
        share = np.cumsum(np.exp(weight - weight.max(axis=0)), axis=0)
        t[large] = 1 + np.count_nonzero(share < u[large] * share[-1], axis=0)
    return t


def _draw_many(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, u: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes with more customers; ``c`` is sorted."""
    goal, turn = c[::-1], u[::-1].copy()
    slope = d * base[::-1]
    first, tables, seated = (theta + d * others[::-1]) * base[::-1], np.ones(len(c)), [1]
    while seated[-1] < goal[0]:
        seated.append(seated[-1] + max(1, seated[-1] // 16))
    # those not yet seated wholly come first
    live = np.searchsorted(-goal, -np.array(seated)).tolist()
    for now, then, n in zip(seated[:-1], seated[1:], live[:-1], strict=True):
        t, x = tables[:n], turn[:n]
        new = slope[:n] * t
        new += first[:n]
        p = new / (new + (now - d * t))
        x += 0.6180339887498949
        x -= x >= 1
        t += np.floor((np.minimum(then, goal[:n]) - now) * p + x)  # the expected number, rounded at random
    return np.minimum(tables.astype(np.int64), goal)[::-1]


#: numbers of customers up to which dishes are drawn together
_RUNS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 25, 32, 40, 50, _EXACT])


def _runs(c: np.ndarray) -> list[tuple[int, slice]]:
    """Runs of the sorted ``c`` that are drawn together, each with the most customers there are in it."""
    ends = [*np.searchsorted(c, _RUNS, side="right").tolist(), len(c)]
    return [(int(c[hi - 1]), slice(lo, hi)) for lo, hi in zip([0, *ends], ends) if hi > lo]  # noqa: B905


def _draw_run(most: int, c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, s: np.ndarray, over: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Numbers of tables of one of ``_runs``."""
    if most < 2:
        return np.minimum(c, 1)
    return _draw_many(c, base, others, d, theta, u) if most > _EXACT else _draw_few(c, base, others, d, theta, s, over, u)


def draw_tables(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, s: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes with ``c`` customers, whose base probabilities are ``base``, beside ``others`` other tables; ``u``: a random number for each."""
    t, over = np.empty(len(c), np.int64), _over_one(s)
    order = argsort(c)
    for most, run in _runs(c[order]):
        i = order[run]
        t[i] = _draw_run(most, c[i], base[i], others[i], d, theta, s, over, u[i])
    return t


def _random(key: np.ndarray, turn: int) -> np.ndarray:
    return ((mix(key + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def seat(part: np.ndarray, outside: np.ndarray, single: np.ndarray, n: np.ndarray, h: np.ndarray, c: np.ndarray, t: np.ndarray, base: np.ndarray, z: dict, turn: int) -> np.ndarray:
    """New tables of the parties of all restaurants of a bucket, after ``z['sweeps']`` sweeps; ``outside``: tables of the same restaurant elsewhere."""
    owner, place = np.repeat(np.arange(len(n)), n), _ranges(n) % _ROUNDS
    tables = outside + single + np.bincount(owner, t, len(n))
    key, s = _pair(h, part[owner]), _log_stirling(z["d1"])
    over = _over_one(s)
    # by round and customers
    order = argsort(c)
    order = order[argsort(place[order])]
    ends = np.searchsorted(place[order], np.arange(_ROUNDS + 1))
    owner, c, base, key, t = owner[order], c[order], base[order], key[order], t[order].astype(np.int64)
    rounds = [(lo, hi, _runs(c[lo:hi])) for lo, hi in zip(ends[:-1], ends[1:], strict=True) if hi > lo]
    for sweep in range(z["sweeps"]):
        u = _random(key, turn * z["sweeps"] + sweep)
        for lo, hi, runs in rounds:
            mine, old = owner[lo:hi], t[lo:hi]
            others = tables[mine] - old
            new = np.concatenate([_draw_run(most, c[lo:hi][i], base[lo:hi][i], others[i], z["d1"], z["theta"], s, over, u[lo:hi][i]) for most, i in runs])
            tables += np.bincount(mine, new - old, len(n))
            t[lo:hi] = new
    out = np.empty(len(t), np.int64)
    out[order] = t
    return out


def _seat(shared: object):  # noqa: ANN202
    """A pass over the restaurants, given the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, z = shared.value
        for batch in batches:
            for i in range(len(batch)):
                part, customers, single, n, h, c, t, total = (_list(batch.column(x)[i]) for x in _REST[1:])
                part, h = part.view(np.uint64), h.view(np.uint64)
                own = single + np.bincount(np.repeat(np.arange(len(n)), n), t, len(n))
                hot = deal.hot_places.find(part)
                outside = np.where(hot >= 0, z["tables"][deal.owner[hot]] - own if len(deal.hot) else 0, 0)
                word = deal.places.find(h)
                base = np.where(word >= 0, z["p0"][word] if len(deal.words) else 0, z["rare"])
                t = seat(part, outside, single, n, h, c, t, base, z, z["turn"])
                kept = _kept(batch.column("kept")[i], len(part))
                if z["keep"]:
                    total = total + t
                    kept = np.vstack([kept, single + np.bincount(np.repeat(np.arange(len(n)), n), t, len(n)).astype(np.int64)])
                yield _bucket_row(batch.column("bucket")[i].as_py(), [part.view(np.int64), customers, single, n, h.view(np.int64), c, t.astype(np.int32), total], kept)

    return run


def _sent_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Customers and tables of each word in the parties of a task's buckets, about half a million at a time."""
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        h, c, t = (np.concatenate(x) for x in zip(*held, strict=True))
        h, order, first = unique(h.view(np.uint64))
        if len(h):
            yield from _rows([h, *(np.add.reduceat(x[order].astype(float), first) for x in (c, t))], ["h", "pc", "t"])

    for batch in batches:
        for i in range(len(batch)):
            held.append(tuple(_list(batch.column(x)[i]) for x in ("h", "c", "t")))
            size += len(held[-1][0])
            if size > 1 << 19:
                yield from out()
                held, size = [], 0
    if size:
        yield from out()


def _split_tables(shared: object):  # noqa: ANN202
    """Customers and tables of the parts of split restaurants, now and in the kept passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal: Deal = shared.value
        for batch in batches:
            for i in range(len(batch)):
                part, customers, single, n, t = (_list(batch.column(x)[i]) for x in ("part", "customers", "single", "n", "t"))
                hot = deal.hot_places.find(part.view(np.uint64))
                on = np.flatnonzero(hot >= 0)
                now = single + np.bincount(np.repeat(np.arange(len(n)), n), t, len(n)).astype(np.int64)
                lists = pa.array(_kept(batch.column("kept")[i], len(part))[:, on].T.tolist(), _long)
                yield pa.RecordBatch.from_arrays([pa.array(deal.owner[hot[on]]), pa.array(customers[on]), pa.array(now[on]), lists], ["owner", "c", "t", "kept"])

    return run


def _seat_parent(shared: object):  # noqa: ANN202
    """The tables of each word in the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        s0 = _log_stirling(z["d0"])
        for batch in batches:
            h, here, t0 = (batch.column(x).to_numpy() for x in ("h", "here", "t0"))
            base = np.full(len(h), z["uniform"])
            for sweep in range(z["sweeps"]):
                t0 = draw_tables(here, base, np.maximum(z["tables0"] - t0, 0), z["d0"], z["theta"], s0, _random(h.view(np.uint64), z["turn"] * z["sweeps"] + sweep))
            yield batch.set_column(batch.schema.get_field_index("t0"), "t0", pa.array(t0))

    return run


class Model:
    """Restaurants of a corpus.  ``words``: h, c and, for each kept pass, p0_0, p0_1, ...; ``rest``: see ``_REST``."""

    def __init__(self, docs: DataFrame, passes: int = 3, burn: int = 1, sweeps: int = 3, theta: float = 1.0, bucket: int = BUCKET):
        """Learn from ``docs`` (text); the first ``burn`` of ``passes`` are not kept, each has ``sweeps`` sweeps."""
        spark = docs.sparkSession
        share = spark.sparkContext.broadcast
        self.docs, self.passes, self.burn = docs, passes, burn
        n_rows = F.count(F.lit(1))
        counts = cut(self.docs.select("text").mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
        one = counts.agg(F.sum("c").alias("n"), n_rows.alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
        self.n, self.v = one.n or 0, one.v
        self.least = max(1.0, FREQUENT * self.n)
        often = counts.where(F.col("c") >= self.least).select("h", "c").toArrow()  # at most 1 / FREQUENT rows
        h = often.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n // bucket))
        self.deal = Deal(h[order], often.column("c").to_numpy()[order], self.n, self.buckets)
        deal = share(self.deal)
        dealt = self.docs.select("text").mapInArrow(_deal_pairs(deal), _DEALT_SQL.format("int"))
        rest = cut(dealt.groupBy("bucket").applyInArrow(_restaurants(deal), _REST_SQL))
        two = rest.agg(F.sum(F.aggregate("single", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n1"), F.sum(F.size(F.filter("c", lambda x: x == 2))).alias("n2")).first()
        discount = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
        z = {"d0": discount(one.n1, one.n2), "d1": discount(two.n1, two.n2), "theta": theta, "uniform": 1.0 / (self.v + 1), "tables0": float(self.v), "sweeps": sweeps}
        self.z = z
        # a word of one token is one customer at one table, always
        self.once, self.n_once = counts.where("c = 1").select("h", "c"), one.n1
        self.words = counts.where("c > 1").select("h", "c", F.lit(1).cast("long").alias("t0"))
        #: parent probability of a word of one token, and of an unknown one, in each kept pass
        self.p0_once: list[float] = []
        self.unknown: list[float] = []
        self._parent(rest, 0, keep=False)
        for turn in range(passes):
            z["turn"], z["keep"] = turn + 1, turn >= burn
            z["tables"] = self._split(rest)[1]
            rest = cut(rest.mapInArrow(_seat(share((self.deal, dict(z)))), _REST_SQL), [rest])
            self._parent(rest, turn + 1, z["keep"])
        self.rest = rest
        #: customers of each frequent word's restaurant where that is split, and its tables in each kept pass
        self.split = self._split(rest)[::2]
        columns = [f"p0_{k}" for k in range(passes - burn)]
        got = self.words.where(F.col("c") >= self.least).select("h", *columns).toArrow()
        #: parent probability of each frequent word in each kept pass
        self.p0 = np.stack([self._of_frequent(got.column("h"), got.column(c).to_numpy(), one) for c, one in zip(columns, self.p0_once, strict=True)], 1)
        one = [F.lit(x).alias(c) for c, x in zip(columns, self.p0_once, strict=True)]
        self.words = self.words.select("h", "c", *columns).unionByName(self.once.select("h", "c", *one))

    def _split(self, rest: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers, tables now, and tables in each kept pass by frequent word, of split restaurants."""
        n, k = len(self.deal.words), self.passes - self.burn
        customers, tables, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, k), np.int64)
        if len(self.deal.hot):
            rows = rest.select("part", "customers", "single", "n", "t", "kept").mapInArrow(_split_tables(rest.sparkSession.sparkContext.broadcast(self.deal)), "owner long, c long, t long, kept array<long>")
            sums = [F.sum(F.get("kept", F.lit(j))).alias(f"k{j}") for j in range(k)]
            for r in rows.groupBy("owner").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), *sums).collect():  # at most 4 for each bucket
                customers[r.owner], tables[r.owner] = r.c, r.t
                kept[r.owner] = [r[f"k{j}"] or 0 for j in range(k)]
        return customers, tables, kept

    def _parent(self, rest: DataFrame, turn: int, keep: bool) -> None:
        """Seat the parent, given the tables of all restaurants."""
        z, spark = self.z, rest.sparkSession
        z["turn"] = turn
        up = rest.select("h", "c", "t").mapInArrow(_sent_up, "h long, pc double, t double").groupBy("h").agg(F.sum("pc").alias("pc"), F.sum("t").alias("t"))
        # pairs of one customer have one table: the word's tokens less the first ones' and the parties'; with the first tokens themselves
        here = (F.col("c") - F.coalesce("pc", F.lit(0.0)) + F.coalesce("t", F.lit(0.0))).cast("long")
        old = self.words
        rows = old.join(up, "h", "left").select(*old.columns, here.alias("here"))
        rows = cut(rows.mapInArrow(_seat_parent(spark.sparkContext.broadcast(dict(z))), rows.schema), [old] if hasattr(old, "cut_path") else [])
        rare = F.col("c") < self.least
        sums = rows.agg(F.sum("here").alias("c"), F.sum("t0").alias("t"), F.sum(F.when(rare, F.col("here"))).alias("rc"), F.sum(F.when(rare, F.col("t0"))).alias("rt"), F.count_if(rare).alias("n")).first()
        z["tables0"] = float((sums.t or 0) + self.n_once)
        unseen, whole = (z["theta"] + z["d0"] * z["tables0"]) * z["uniform"], z["theta"] + (sums.c or 0) + self.n_once
        p0 = (F.col("here") - F.lit(z["d0"]) * F.col("t0") + F.lit(unseen)) / F.lit(whole)
        once = self.n_once if self.least > 1 else 0
        n = max(1, sums.n + once)
        z["rare"] = ((sums.rc or 0) - z["d0"] * (sums.rt or 0) + once * (1 - z["d0"]) + unseen * n) / whole / n
        got = rows.where(~rare).select("h", p0.alias("p")).toArrow()
        one = (1 - z["d0"] + unseen) / whole
        z["p0"] = self._of_frequent(got.column("h"), got.column("p").to_numpy(), one)
        path = rows.cut_path
        self.words = rows.withColumn(f"p0_{turn - 1 - self.burn}", p0).drop("here") if keep else rows.drop("here")
        self.words.cut_path = path
        if keep:
            self.unknown.append(unseen / whole if self.n else 1.0)
            self.p0_once.append(one)

    def _of_frequent(self, h: pa.ChunkedArray, p: np.ndarray, once: float) -> np.ndarray:
        """``p`` by frequent word; ``once`` for those of one token, which are frequent in a small corpus only."""
        out = np.full(len(self.deal.words), once)
        out[self.deal.places.find(h.to_numpy().view(np.uint64))] = p
        return out

    def _frequent_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, probabilities) of the pairs with at least ``least`` tokens, sorted."""
        spark, least = self.rest.sparkSession, self.least
        shared = spark.sparkContext.broadcast(self._known())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for i in range(len(batch)):
                    x = known.bucket(batch.slice(i, 1))
                    on = np.flatnonzero(x["c"] >= least)
                    p = x["own"][on] + (x["rest"][x["owner"][on]] * known.p0[known.deal.places.find(x["h"][on])]).mean(axis=1)
                    yield from _rows([_pair(x["h"][on], x["part"][x["owner"][on]]), p], ["k", "p"])

        got = self.rest.mapInArrow(run, "k long, p double").toArrow()  # at most 1 / FREQUENT rows
        k = got.column("k").to_numpy().view(np.uint64)
        order = np.argsort(k)
        return k[order], got.column("p").to_numpy()[order]

    def _known(self) -> Known:
        return Known(self.deal, self.p0, *self.split, self.z["d1"], self.z["theta"], self.passes - self.burn)

    def score(self, docs: DataFrame, train: Column | None = None) -> DataFrame:
        """n_tokens, n_known, base_score and score for each row of ``docs``, after its columns but ``text``, none of which may be named like an output or internal column.

        ``train``: which rows the model has learned from, if these are among ``docs``; else the corpus is read once more beside them.
        """
        spark = docs.sparkSession
        kept = [c for c in docs.columns if c != "text"]
        if train is None:
            rows = docs.select("text", *kept, F.lit(False).alias("_train"), F.lit(True).alias("_scored"))
            rows = rows.unionByName(self.docs.select("text", F.lit(True).alias("_train"), F.lit(False).alias("_scored")), allowMissingColumns=True)
        else:
            rows = docs.select("text", *kept, train.alias("_train"), F.lit(True).alias("_scored"))
        known = self._known()
        shared = spark.sparkContext.broadcast((known, self.deal.counts.astype(np.float64), self._frequent_pairs(), self.n + 0.5 * (self.v + 1)))
        k = known.kept
        shares = [f"r{j}" for j in range(k)]
        out_sql = "key long, h long, n long, known long, base double, score double, own double" + "".join(f", {r} double" for r in shares)
        own = T.StructType([docs.schema[c] for c in kept])
        mapped = spark.createDataFrame([], _DEALT_SQL.format("short") + ", " + out_sql.replace("key long, ", "")).schema
        mapped = T.StructType([*mapped.fields, *own.fields])
        result = T.StructType([*spark.createDataFrame([], out_sql).schema.fields, *own.fields])
        rows = rows.withColumn("_key", F.monotonically_increasing_id())
        dealt = rows.mapInArrow(_read_texts(shared, mapped.names, kept), mapped)
        found = dealt.groupBy("bucket").cogroup(self.rest.groupBy("bucket")).applyInArrow(_score_bucket(shared, result.names), result)
        found = cut(found)
        # rare words meet their parent probability
        alone = found.where("h is not null").select("key", "h", "own", *shares)
        met = alone.join(self.words.where(F.col("c") < self.least).select("h", "c", *[f"p0_{j}" for j in range(k)]), "h", "left")
        p = sum((F.col(f"r{j}") * F.coalesce(F.col(f"p0_{j}"), F.lit(float(self.unknown[j]))) for j in range(k)), F.lit(0.0)) / k + F.col("own")
        base = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(self.n + 0.5 * (self.v + 1)))
        met = met.select("key", F.col("c").isNotNull().cast("long").alias("known"), base.alias("base"), F.log10(p).alias("score"))
        names = ["key", "n", "known", "base", "score", *kept]
        every = found.where("h is null").select(*names).unionByName(met, allowMissingColumns=True)
        sums = every.groupBy("key").agg(*[F.max(c).alias(c) for c in (*kept, "n")], *[F.sum(c).alias(c) for c in ("known", "base", "score")]).where("n is not null")
        return sums.select(*kept, F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.col("base").alias("base_score"), "score")


class Known:
    """What every task knows of a model: frequent words, their parent probabilities, and the totals of split restaurants."""

    def __init__(self, deal: Deal, p0: np.ndarray, customers: np.ndarray, tables: np.ndarray, d: float, theta: float, kept: int):
        self.deal, self.p0, self.customers, self.tables, self.d, self.theta, self.kept = deal, p0, customers, tables, d, theta, kept

    def bucket(self, t: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
        """The restaurants of a bucket: what each leaves to its parent in each kept pass, and what each party has of its own."""
        if not len(t):
            none = np.zeros(0, np.int64)
            return {"part": none.view(np.uint64), "customers": none, "rest": np.zeros((0, self.kept)), "owner": none, "h": none.view(np.uint64), "c": none, "own": none.astype(float)}
        part, customers, _, n, h, c, _, total = (_list(t.column(x)[0]) for x in _REST[1:])
        part = part.view(np.uint64)
        tables = _kept(t.column("kept")[0], len(part)).T
        hot = self.deal.hot_places.find(part)
        on = np.flatnonzero(hot >= 0)
        if len(on):
            customers, tables = customers.copy(), tables.copy()
            customers[on], tables[on] = self.customers[self.deal.owner[hot[on]]], self.tables[self.deal.owner[hot[on]]]
        owner = np.repeat(np.arange(len(n)), n)
        whole = self.theta + customers
        return {"part": part, "customers": customers, "rest": (self.theta + self.d * tables) / whole[:, None], "owner": owner, "h": h.view(np.uint64), "c": c, "own": (c - self.d * total / self.kept) / whole[owner]}


def _table(names: list[str], schema: pa.Schema | None = None, **columns: np.ndarray) -> pa.RecordBatch:
    """A batch with ``columns``, all others null."""
    n = len(next(iter(columns.values())))
    made = [columns.get(c) for c in names]
    return pa.RecordBatch.from_arrays([pa.nulls(n, schema.field(c).type if schema else pa.null()) if x is None else x if isinstance(x, (pa.Array, pa.ChunkedArray)) else signed(x) if x.dtype == np.uint64 else pa.array(x) for c, x in zip(names, made, strict=True)], names)


def _arrow(names: list[str], kept: dict[str, pa.DataType]) -> pa.Schema:
    short = pa.list_(pa.int16())
    kinds = {"bucket": pa.int32(), "part": _long, "often": _int, "rare": _int, "f": _int, "r": _long, "of": short, "or": short, "key": pa.int64(), "h": pa.int64(), "n": pa.int64(), "known": pa.int64()} | kept
    return pa.schema([(c, kinds.get(c, pa.float64())) for c in names])


def _read_texts(shared: object, names: list[str], kept: list[str]):  # noqa: ANN202
    """A row for each text with what frequent words and pairs tell; all other tokens dealt to buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, pairs, whole = shared.value
        deal, pair_p = known.deal, np.log10(pairs[1])
        pairs, p0, base_p = Places(pairs[0]), np.log10(known.p0.mean(axis=1)), np.log10((counts + 0.5) / whole)
        held, size, texts = [], 0, 0
        schema = None

        def out() -> pa.RecordBatch:
            h, place, part, key, train = (np.concatenate(x) for x in zip(*held, strict=True))
            order = argsort(part)
            low = int(key.min())
            rows = deal.rows(part[order], h[order], place[order], ((key - low) * 2 + train).astype(np.int16)[order], low)
            return _table(names, schema, **{c: rows.column(c) for c in _DEALT})

        for batch in batches:
            if schema is None:
                schema = _arrow(names, {c: batch.schema.field(c).type for c in kept})
            keys, trains, scored = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_train", "_scored"))
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                h, before, row = tokens(data, offsets)
                n, alone, mine = hi - lo, before == 0, scored[lo:hi]
                word = deal.places.find(h)
                last = np.append(-1, word[:-1])
                last[alone] = -1
                own = deal.part_of(before, h, last)
                on = np.flatnonzero(word >= 0)
                n_known = np.bincount(row[on], minlength=n)
                base = np.bincount(row[on], base_p[word[on]], n).astype(float)
                # both words of a frequent pair are frequent
                on = on[last[on] >= 0]
                at = np.full(len(h), -1, np.int64)
                at[on] = pairs.find(_pair(h[on], own[on]))
                on = on[at[on] >= 0]
                score = np.bincount(row[on], pair_p[at[on]], n).astype(float)
                on = np.flatnonzero(alone & (word >= 0))
                score += np.bincount(row[on], p0[word[on]], n)
                yield _table(
                    names, schema, bucket=(keys[lo:hi] % deal.buckets).astype(np.int32), key=keys[lo:hi], n=np.bincount(row, minlength=n), known=n_known, base=base, score=score,
                    **{c: batch.column(c).slice(lo, n) for c in kept},
                ).filter(pa.array(mine))
                first = np.flatnonzero(alone & (word < 0) & mine[row])
                if len(first):
                    one = {f"r{j}": np.ones(len(first)) for j in range(known.kept)}
                    yield _table(names, schema, bucket=(keys[lo + row[first]] % deal.buckets).astype(np.int32), key=keys[lo + row[first]], h=h[first], own=np.zeros(len(first)), **one)
                left = np.flatnonzero(~alone & (at < 0))
                # keys follow on one another within a task but for where rows come from another table
                if texts and (size + len(left) > 2 * _HELD or keys[hi - 1] - held[0][3].min() >= _TEXTS):
                    yield out()
                    held, size, texts = [], 0, 0
                for a in range(lo, hi, _TEXTS):
                    part = left[(row[left] >= a - lo) & (row[left] < a - lo + _TEXTS)]
                    if len(part):
                        held.append((h[part], word[part].astype(np.int32), own[part], keys[lo + row[part]], trains[lo + row[part]]))
                        size, texts = size + len(part), texts + 1
                    if hi - lo > _TEXTS and texts:
                        yield out()
                        held, size, texts = [], 0, 0
                if size > _HELD:
                    yield out()
                    held, size, texts = [], 0, 0
        if texts:
            yield out()

    return run


def _score_bucket(shared: object, names: list[str]):  # noqa: ANN202
    def run(dealt: pa.Table, rest: pa.Table) -> pa.Table:
        known: Known = shared.value[0]
        deal = known.deal
        kept = {c: dealt.schema.field(c).type for c in names if c in dealt.column_names}
        schema = _arrow(names, {c: t for c, t in kept.items() if not pa.types.is_list(t)})
        told = dealt.filter(pc.is_null(dealt.column("part")))
        out = [told.select([c for c in names])]
        dealt = dealt.filter(pc.is_valid(dealt.column("part")))
        part, h, word, code, row = deal.read(dealt)
        if len(h):
            key, train = dealt.column("key").to_numpy()[row] + (code >> 1), code & 1
            x = known.bucket(rest)
            at = Places(x["part"]).find(part)
            found = at >= 0
            customers = np.where(found, x["customers"][at] if len(x["part"]) else 0, 0)
            share = np.where(found[:, None], x["rest"][at] if len(x["part"]) else 1.0, 1.0)
            pair, party = _pair(h, part), _pair(x["h"], x["part"][x["owner"]])
            order = argsort(party)
            i = Places(party[order]).find(pair)
            own = np.where(i >= 0, x["own"][order][i] if len(party) else 0.0, 0.0)
            # pairs that are no party: those that the corpus has once have one table
            no = np.flatnonzero(i < 0)
            _, order, first = unique(pair[no])
            if len(no):
                no = no[order]
                once = np.repeat(np.add.reduceat(train[no], first) == 1, np.diff(np.append(first, len(no))))
                own[no[once]] = (1 - known.d) / (known.theta + customers[no[once]])
            on = np.flatnonzero(word >= 0)
            p = own[on] + (share[on] * known.p0[word[on]]).mean(axis=1)
            # a row has texts of its own
            texts, order, first = unique((row[on] << 15) + (code[on] >> 1))
            if len(texts):
                zero, keys = np.zeros(len(texts)), key[on[order[first]]]
                out.append(pa.Table.from_batches([_table(names, schema, key=keys, known=zero.astype(np.int64), base=zero, score=np.add.reduceat(np.log10(p)[order], first))]))
            on = np.flatnonzero(word < 0)
            out.append(pa.Table.from_batches([_table(names, schema, key=key[on], h=h[on], own=own[on], **{f"r{j}": share[on, j] for j in range(known.kept)})]))
        return pa.concat_tables([t.cast(schema) for t in out])

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    Rows whose crc32 of the id is 1 modulo 5 are held out: scored, never learned from.  Null and empty texts are the end
    token alone.  The fold of a null id is that of the empty text.  Repeated rows count and are scored each.  Other
    columns are ignored.  An empty table gives an empty result; without training rows every token has probability 1 in
    the model and 0.5 / (0.5) in the base.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold_of(F.col("doc_id"), 5) == 1).alias("held_out"))
    model = Model(docs.where("not held_out"))
    out = model.score(docs, ~F.col("held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
