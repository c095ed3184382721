"""Conversation prefix trie by parallel tree contraction (operator 11).

Conversations that begin with the same turns share nodes.  A beginning is named by its polynomial hash of 128 bits, which
is a running sum over the turns in order; a range partitioner deals the turns, so that one conversation of any length lies
in many tasks, and the sums before each task are added afterwards.  Nodes are the distinct names; from then on a node is
its smallest conversation and its depth.

Subtree totals come from contraction.  In each round all leaves are raked into their parents, and nodes with one child left
are compressed: such a node is spliced out, and its sum is put on the edge between its child and its parent, if it comes
before both neighbours in the order of the lowest set bit of the depth, then of a hash.  A fresh chain has consecutive
depths, so each round takes every other node of it, and the rounds are logarithmic in nodes.  Both steps are messages to
parents and to children that are summed by node, partially before the shuffle, so a node with any number of children is no
hot key.  Re-expansion: a raked node's total is known, a spliced one's is its sum plus the total of the child it was spliced
onto; these pointers are doubled until all are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_FULL = 1 << 64
#: turns that a conversation may take over from another
_MOST_TAKEN = 8
#: characters of ids that go to a hash as one row
_CHUNK = 1 << 15

_TURNS = "part int, conv_id long, p long, bytes long, a long, b long, before_a long, before_b long"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _ulong(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns with their place p in the conversation (from 1), the bytes of their text, and the hash of the turns up to and before them."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    narrow = cut(rows)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, count, carry = None, 0, [np.uint64(0)] * 2
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            ids = batch.column("conv_id").to_numpy()
            raw = batch.column("digest").cast(pa.binary(16))
            turn = np.frombuffer(raw.buffers()[1], "<u8").reshape(-1, 2)[raw.offset : raw.offset + n]
            fresh = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            run = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, n)))
            along = np.arange(n) - fresh[run]
            goes_on = conv is not None and ids[0] == conv
            p = along + 1
            if goes_on:
                p[run == 0] += count
            out = []
            for k, base in enumerate(_BASES):
                power = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))[along] * np.uint64(base)
                if goes_on:
                    power[run == 0] *= np.uint64(pow(base, count, _FULL))
                term = turn[:, k] * power
                total = np.cumsum(term)
                total -= (total - term)[fresh][run]
                if goes_on:
                    total[run == 0] += carry[k]
                out.append((total, total - term))
                carry[k] = total[-1]
            conv, count = ids[-1], int(p[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), batch.column("conv_id"), pa.array(p), batch.column("bytes"), _long(out[0][0]), _long(out[1][0]), _long(out[0][1]), _long(out[1][1])],
                ["part", "conv_id", "p", "bytes", "a", "b", "before_a", "before_b"],
            )

    local = cut(narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sums, _TURNS), free=[narrow])
    # one row for each task: its first and last conversation, and where it stopped in the last
    last = F.max_by(F.struct("p", "a", "b"), F.struct("conv_id", "p"))
    ends = sorted(local.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"), last.alias("last")).collect())
    offsets: dict[int, tuple[int, int, list[int]]] = {}  # task -> its first conversation, turns before, hash before
    for before, now in zip(ends, ends[1:], strict=False):
        if before.hi == now.lo:
            n, done = before["last"].p, [before["last"].a % _FULL, before["last"].b % _FULL]
            if before.part in offsets and before.lo == before.hi:
                _, m, old = offsets[before.part]
                n, done = n + m, [(o + d * pow(base, m, _FULL)) % _FULL for o, d, base in zip(old, done, _BASES, strict=True)]
            offsets[now.part] = (now.lo, n, done)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, ids, p = (batch.column(c).to_numpy() for c in ("part", "conv_id", "p"))
            sums_ = [_ulong(batch.column(c)).copy() for c in ("a", "b", "before_a", "before_b")]
            p = p.copy()
            for k in np.unique(part):
                if int(k) in offsets:
                    conv, n, done = offsets[int(k)]
                    rows_ = (part == k) & (ids == conv)
                    p[rows_] += n
                    for x, base, d in zip(sums_, _BASES * 2, done * 2, strict=True):
                        x[rows_] = x[rows_] * np.uint64(pow(base, n, _FULL)) + np.uint64(d)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("conv_id"), pa.array(p), batch.column("bytes"), *map(_long, sums_)], batch.schema.names)

    return local.mapInArrow(moved, _TURNS) if offsets else local


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, hash of the turns up to and before it, bytes, whether it is the last) of conversations as they are rebuilt, from depth 0.

    Conversation c has the first h turns of c - c % 5, then its own after its first h, with h = crc32(c) % 9.
    """
    n = cut(turns.groupBy("conv_id").agg(F.max("p").alias("n")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (_MOST_TAKEN + 1)).cast("long")
    convs = n.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("donor"))
    convs = convs.join(n.select(F.col("conv_id").alias("donor"), F.col("n").alias("m")), "donor", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("m", F.lit(0).cast("long"))))
    heads = turns.where(F.col("p") <= _MOST_TAKEN)
    zero = F.lit(0).cast("long")
    given = heads.select(F.col("conv_id").alias("donor"), F.col("p").alias("k"), F.col("a").alias("given_a"), F.col("b").alias("given_b"))
    own = heads.select("conv_id", F.col("p").alias("h"), F.col("a").alias("own_a"), F.col("b").alias("own_b"))
    info = convs.join(given, ["donor", "k"], "left").join(own, ["conv_id", "h"], "left")
    info = cut(info.select("conv_id", "n", "h", "donor", "k", *[F.coalesce(c, zero).alias(c) for c in ("given_a", "given_b", "own_a", "own_b")]), free=[n])
    whole = F.col("n") <= F.col("h")
    names = ["conv_id", "depth", "a", "b", "before_a", "before_b", "bytes", "last"]
    root = info.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in names[2:7]], (whole & (F.col("k") == 0)).alias("last"))
    taken = info.where("k > 0").select("conv_id", "donor", "k", whole.alias("_whole")).join(heads.withColumnRenamed("conv_id", "donor"), "donor").where("p <= k")
    taken = taken.select("conv_id", F.col("p").alias("depth"), *names[2:7], (F.col("_whole") & (F.col("p") == F.col("k"))).alias("last"))

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a turn moved from place p to p + k - h: its power of the base changes by k - h, from -8 to 0
        shifts = [np.array([pow(base, -s, _FULL) for s in range(_MOST_TAKEN + 1)], np.uint64) for base in _BASES]
        for batch in batches:
            p, h, k, n = (batch.column(c).to_numpy() for c in ("p", "h", "k", "n"))
            x = {c: _ulong(batch.column(c)) for c in ("a", "b", "before_a", "before_b", "given_a", "given_b", "own_a", "own_b")}
            new = [_long(x[f"given_{c}"] + (x[f"{before}{c}"] - x[f"own_{c}"]) * shifts["ab".index(c)][h - k]) for before in ("", "before_") for c in "ab"]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(p - h + k), *new, batch.column("bytes"), pa.array(p == n)], names)

    kept = turns.join(info.drop("donor"), "conv_id").where("p > h").drop("part")
    kept = kept.mapInArrow(tail, "conv_id long, depth long, a long, b long, before_a long, before_b long, bytes long, last boolean")
    return cut(root.unionByName(taken).unionByName(kept), free=[info])


def ends_hashes(rows: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the nodes at which conversations end: of their ids, ascending, comma-joined.

    Ids are joined where a range partitioner deals them; a hash then takes whole strings in order, a string of ids at a time.
    """
    ends = rows.where("last").select("depth", "a", "b", "conv_id")
    key = ["depth", "a", "b"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*node, held[0])), pa.array([",".join(map(str, held))])], [*key, "first", "ids"])

        for batch in batches:
            done: list[tuple] = []
            for *now, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id")), strict=True):
                if now != node or size > _CHUNK:
                    if held:
                        done.append((*node, held[0], ",".join(map(str, held))))
                    node, held, size = now, [], 0
                held.append(conv)
                size += len(str(conv)) + 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [*key, "first", "ids"])
        if held:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if now != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [*key, "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([state.hexdigest()])], [*key, "ends_sha256"])

    order = [*key, "conv_id"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "depth long, a long, b long, first long, ids string")
    return chunks.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


# ---------------------------------------------------------------- contraction

_SUMS = ["saved", "leaves"]


def _before(c: str, d: str) -> Column:
    """The order in which nodes are spliced out; the root comes last."""
    low = F.when(F.col(d) == 0, F.lit((1 << 63) - 1)).otherwise(F.col(d).bitwiseAND(-F.col(d)))
    return F.struct(low.alias("x"), F.xxhash64(c, d).alias("y"), F.col(c).alias("z"), F.col(d).alias("w"))


def subtree_sums(tree: DataFrame) -> DataFrame:
    """conv_id, depth and the subtree totals of ``saved`` and ``leaves``.

    tree: conv_id, depth, up_conv and up_depth (null at roots), n_children, saved, leaves (values of the node itself).
    """
    spark = tree.sparkSession
    key, zero = ["conv_id", "depth"], F.lit(0).cast("long")
    up, down = ["up_conv", "up_depth"], ["kid_conv", "kid_depth"]
    edge, kid_edge = [f"edge_{s}" for s in _SUMS], [f"kid_edge_{s}" for s in _SUMS]
    null = lambda names: [F.lit(None).cast("long").alias(c) for c in names]
    own = [*up, "n_children", *_SUMS, *edge]
    state = cut(tree.select(*key, *up, F.col("n_children").cast("long").alias("n_children"), *[F.col(s).cast("long").alias(s) for s in _SUMS], *[zero.alias(c) for c in edge], *null(down)))
    rounds = [state]
    while True:
        live = state.where("kid_conv IS NULL")
        if not live.count():
            break
        # rake: leaves tell their parents their sums; the others tell who they are, which counts for a parent with one child left
        leaf = F.col("n_children") == 0
        told = live.where("up_conv IS NOT NULL")
        added = [F.when(leaf, F.col(s) + F.col(e)).otherwise(zero).alias(f"add_{s}") for s, e in zip(_SUMS, edge, strict=True)]
        who = [F.when(~leaf, F.col(c)).alias(k) for c, k in zip([*key, *edge], [*down, *kid_edge], strict=True)]
        messages = told.select(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"), *null(own), F.when(leaf, 1).otherwise(0).cast("long").alias("raked"), *added, *who)
        stay = live.where(~leaf).select(*key, *own, *null(["raked", *[f"add_{s}" for s in _SUMS], *down, *kid_edge]))
        got = stay.unionByName(messages).groupBy(*key).agg(
            *[F.max(c).alias(c) for c in own], *[F.coalesce(F.sum(c), zero).alias(c) for c in ("raked", *(f"add_{s}" for s in _SUMS))], *[F.max(c).alias(c) for c in (*down, *kid_edge)]
        )
        got = got.select(*key, *up, (F.col("n_children") - F.col("raked")).alias("n_children"), *[(F.col(s) + F.col(f"add_{s}")).alias(s) for s in _SUMS], *edge, *down, *kid_edge)
        # compress
        goes = (F.col("n_children") == 1) & F.col("up_conv").isNotNull() & (_before(*key) < _before(*up)) & (_before(*key) < _before(*down))
        got = got.withColumn("goes", goes)
        gone = got.where("goes")
        stay = got.where("NOT goes").select(*key, *own, *null([*down, "new_conv", "new_depth", *(f"add_{s}" for s in _SUMS)]))
        spliced = gone.select(
            *key, *null([*up, "n_children"]), *[(F.col(s) + F.col(k)).alias(s) for s, k in zip(_SUMS, kid_edge, strict=True)], *null(edge), *down, *null(["new_conv", "new_depth", *(f"add_{s}" for s in _SUMS)])
        )
        messages = gone.select(
            F.col("kid_conv").alias("conv_id"), F.col("kid_depth").alias("depth"), *null([*own, *down]),
            F.col("up_conv").alias("new_conv"), F.col("up_depth").alias("new_depth"), *[(F.col(s) + F.col(e)).alias(f"add_{s}") for s, e in zip(_SUMS, edge, strict=True)],
        )
        moved = stay.unionByName(spliced).unionByName(messages).groupBy(*key).agg(*[F.max(c).alias(c) for c in (*own, *down, "new_conv", "new_depth", *(f"add_{s}" for s in _SUMS))])
        moved = moved.select(
            *key, F.coalesce("new_conv", "up_conv").alias("up_conv"), F.coalesce("new_depth", "up_depth").alias("up_depth"), "n_children", *_SUMS,
            *[(F.col(e) + F.coalesce(f"add_{s}", zero)).alias(e) for s, e in zip(_SUMS, edge, strict=True)], *down,
        )
        state = cut(moved)
        rounds.append(state)
    # re-expand: raked nodes are done, spliced ones wait for the child they were spliced onto
    every = spark.read.schema(state.schema).parquet(*[r.cut_path for r in rounds])
    known = cut(every.where("kid_conv IS NOT NULL OR n_children = 0").select(*key, *down, *_SUMS), free=rounds)
    for _ in range(len(rounds).bit_length()):  # a pointer leads to a node that went in the same round or later
        of = known.select(F.col("conv_id").alias("kid_conv"), F.col("depth").alias("kid_depth"), *[F.col(c).alias(f"_{c}") for c in (*down, *_SUMS)])
        waits = known.where("kid_conv IS NOT NULL").join(of, down).select(*key, *[F.col(f"_{c}").alias(c) for c in down], *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in _SUMS])
        known = cut(known.where("kid_conv IS NULL").unionByName(waits), free=[known])
    return known.select(*key, *_SUMS)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text): a row for each node.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves
    (in its subtree), saved_tokens (in its subtree, each node's members but one times the bytes of its last text), and
    ends_sha256 (of the ids of the conversations that end there).

    Turns are in order of ``turn``, null first; turns of equal number by a hash of role and text, repeated ones each.  A
    null role or text is empty.  Rows without conv_id belong to no conversation and are left out.  Other columns are
    ignored; an empty table has no node.
    """
    rows = rebuilt(numbered(conversations))
    nodes = rows.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("before_a", "before_b", "bytes")])
    nodes = cut(nodes)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("before_a"), F.col("b").alias("before_b"), F.col("conv_id").alias("up_conv"))
    tree = nodes.join(above, ["depth", "before_a", "before_b"], "left")
    own = [c for c in tree.columns if c not in ("conv_id", "depth")]
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    # each node with the number of its children
    told = tree.where("depth > 0").select(F.col("up_conv").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("kids"))
    both = tree.withColumn("kids", F.lit(0).cast("long")).unionByName(told, allowMissingColumns=True)
    tree = both.groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in own], F.sum("kids").alias("n_children"))
    up = F.when(F.col("depth") > 0, F.col("depth") - 1)
    tree = cut(tree.select("conv_id", "depth", "a", "b", "n_convs", "up_conv", up.alias("up_depth"), "n_children", saved.alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves")), free=[nodes])
    sums = subtree_sums(tree).select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    out = tree.join(ends_hashes(rows), ["depth", "a", "b"], "left").join(sums, ["conv_id", "depth"])
    return out.select("conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 bit by bit, then the trie with nodes named by their turns' digests
SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
bits AS (SELECT conv_id, n, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
    lambda i: list_transform(range(0, 8), lambda b: (ascii(substr(conv_id::VARCHAR, i, 1)) >> b) & 1)))::UBIGINT[] AS bits FROM n),
crc AS (SELECT conv_id, n, (xor(list_reduce(list_prepend(4294967295::UBIGINT, bits),
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END), 4294967295::UBIGINT) % 9)::BIGINT AS h FROM bits),
k AS (SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS donor, c.h, least(c.h, coalesce(d.n, 0)) AS k
    FROM crc c LEFT JOIN n d ON d.conv_id = c.conv_id - c.conv_id % 5),
r AS (SELECT k.conv_id, t.p AS d, t.role, t.text FROM k JOIN t ON t.conv_id = k.donor AND t.p <= k.k
    UNION ALL SELECT k.conv_id, t.p - k.h + k.k, t.role, t.text FROM k JOIN t ON t.conv_id = k.conv_id AND t.p > k.h),
x AS (SELECT conv_id, d, strlen(text) AS bytes, md5(string_agg(md5(strlen(role) || ':' || role || text), '' ORDER BY d) OVER w) AS name, d = max(d) OVER (PARTITION BY conv_id) AS last
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM k),
m AS (SELECT conv_id AS c, d, bytes, last, min(conv_id) OVER (PARTITION BY d, name) AS conv_id FROM x),
v AS (SELECT conv_id, d, count(*) AS n_convs, any_value(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last) AS ends FROM m GROUP BY conv_id, d),
p AS (SELECT v.*, u.conv_id AS parent FROM v LEFT JOIN m u ON u.c = v.conv_id AND u.d = v.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS kids FROM p WHERE d > 0 GROUP BY ALL),
f AS (SELECT p.*, coalesce(kids, 0) AS kids FROM p LEFT JOIN kids USING (conv_id, d)),
below AS (SELECT u.conv_id, u.d, sum((f.n_convs - 1) * f.bytes) AS saved, count(*) FILTER (WHERE f.kids = 0) AS leaves
    FROM f JOIN m u ON u.c = f.conv_id AND u.d <= f.d GROUP BY u.conv_id, u.d)
SELECT f.conv_id, f.d::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs, f.kids AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN below b USING (conv_id, d)
"""
