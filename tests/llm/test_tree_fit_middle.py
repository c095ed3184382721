"""Prefix trie, best-fit packing and fill-in-the-middle against brute force."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.llm import best_fit, fill_in_middle, prefix_trie

CONV = "conv_id long, turn long, role string, text string"


# ---------------------------------------------------------------- prefix trie


def trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        new = tuple(own.get(donor, [])[:h] + turns[h:])
        for d in range(len(new) + 1):
            members[new[:d]].append(c)
        ends[new].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], digest(k)) for k, m in members.items())


def same_trie(spark, rows, parts=4):
    df = spark.createDataFrame(rows, CONV).repartition(parts).withColumn("depth", F.lit(1)).withColumn("a", F.lit("x")).withColumn("p", F.lit(0))
    assert Counter(map(tuple, prefix_trie.prefix_trie(df).collect())) == trie(rows)


def test_trie(spark):
    rnd = random.Random(1)
    rows = []
    for c in [*range(60), -7, -5, 10**12, 10**12 + 1]:
        rows += [(c, t, rnd.choice(["user", None, ""]), rnd.choice(["a", "bé", "", None])) for t in range(rnd.choice([1, 2, 5, 14]))]
    rows += [(3, None, "user", "first"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (3, 2, "bot", "tie"), (None, 1, "user", "no id"), (7, -4, None, None)]
    same_trie(spark, rows)


def test_trie_of_equal_conversations_and_a_long_one(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 200, 5) for t in range(9)]
    rows += [(1, t, "user", f"long {t // 2}") for t in range(700)] + [(2, 0, "user", "x")]
    same_trie(spark, rows, 8)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONV)).collect() == []
    same_trie(spark, [(4, None, None, None)])


def test_contraction(spark):
    rnd = random.Random(5)
    up, n = [], 100
    for shape in ("chain", "star", "caterpillar", "random"):  # a tree of each
        at = len(up)
        up.append(None)
        up += [at + {"chain": i - 1, "star": 0, "caterpillar": i - 1 if i % 2 else max(0, i - 2), "random": rnd.randrange(i)}[shape] for i in range(1, n)]
    depth = []
    for u in up:
        depth.append(0 if u is None else depth[u] + 1)
    kids, value = Counter(up), [rnd.randint(0, 9) for _ in up]
    want, leaves = value[:], [int(not kids[i]) for i in range(len(up))]
    for i in range(len(up) - 1, 0, -1):
        if up[i] is not None:
            want[up[i]] += want[i]
            leaves[up[i]] += leaves[i]
    rows = [(i, depth[i], u, None if u is None else depth[u], kids[i], value[i], int(not kids[i])) for i, u in enumerate(up)]
    got = prefix_trie.subtree_sums(spark.createDataFrame(rows, "conv_id long, depth long, up_conv long, up_depth long, n_children long, saved long, leaves long"))
    assert sorted(map(tuple, got.collect())) == sorted(zip(range(len(up)), depth, want, leaves, strict=True))


# ---------------------------------------------------------------- best fit


def test_words_have_the_tokens_of_the_text(monkeypatch):
    encoder = best_fit._encoder(None)
    parts = [" ", " ", "\n", "\t", "\r", "\v", "\f", "\x1c", "\x85", "\xa0", " ", "​", "　", " zymurgy", "1024", ",", "a", "The", "'s", "'ll", "don't", ".", "!!", "é", "é", "İ", "Σ", "中", "<|endoftext|>", "<|end", "﻿", "́", "😀", "\x00", "Ünïcödé", "straße", "ÿ", "ÀÖ", "...", "-", "$$$", "&*", "A", "·", "ª"]
    rng = np.random.default_rng(4)
    monkeypatch.setattr(best_fit, "_REMEMBERED", 300)
    import pyarrow as pa

    for _ in range(1000):
        texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(rng.integers(1, 9))]
        ids, counts = encoder.encode(pa.array(["skipped", *texts])[1:])
        want = [[*x.ids, 0] for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def sequences(lengths, window):
    """One piece after another, longest first, to the open sequence with the least room; how full all sequences get.  (Which one of several with the same room is open.)"""
    rooms, held = [], []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, (n, -1))
        room, k = rooms.pop(at) if at < len(rooms) else (window, len(held))
        if k == len(held):
            held.append([])
        held[k].append(n)
        insort(rooms, (room - n, k))
    return Counter(map(sum, held))


def test_plan_is_that_of_one_piece_after_another():
    rng = np.random.default_rng(1)
    for lengths in ([], [64] * 7, [3] * 1000, [40] * 5 + [20] * 9 + [1] * 300, *(rng.integers(1, 65, n) for n in (1, 10, 500, 3000)), rng.geometric(0.2, 4000).clip(1, 64)):
        hist = np.bincount(np.array(lengths, np.int64), minlength=65)
        plan = best_fit.best_fit_decreasing(hist, 64)
        held = defaultdict(list)
        for (length, lo, each, first, offset), after in zip(plan, [*plan[1:], (0, 0)], strict=False):
            hi = after[1] if after[0] == length else hist[length]
            for rank in range(lo, hi):
                held[first + (rank - lo) // each].append((offset + (rank - lo) % each * length, length))
        assert sorted(held) == list(range(len(held)))
        for x in held.values():
            x.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and x[0][0] == 0 and sum(x[-1]) <= 64
        assert Counter(sum(n for _, n in x) for x in held.values()) == sequences(lengths, 64)


def test_tightest_room():
    rnd = random.Random(2)
    for most in (1, 5, 64, 100):
        tree, rooms = best_fit.RoomTree(most), Counter()
        for _ in range(300):
            room = rnd.randint(1, most)
            times = rnd.choice([1, 3]) if not rooms[room] else -rooms[room]
            tree.add(room, times)
            rooms[room] += times
            need = rnd.randint(1, most)
            assert tree.tightest(need) == min((r for r, n in rooms.items() if n and r >= need), default=None)


def test_best_fit(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(3)
    rows = [(i, " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.choice([3, 50, 400, 2500])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "<|endoftext|> \n\n\t x" + " " * 3000), (5, "again"), (5, "again"), (None, "no id"), (103, "𝒳é " * 4000), (104, "x" * 5000)] + [(200 + i, "same text") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("piece", F.lit(0))
    got = best_fit.pack_best_fit(df).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 2048
    assert Counter(sum(n for _, n in x) for x in held.values()) == sequences([r.length for r in got], 2048)
    assert best_fit.pack_best_fit(df.limit(0)).collect() == []
    with_ids = best_fit.pieces(df.where("doc_id = 103"), 2048, with_ids=True).orderBy("piece").collect()
    assert [i for r in with_ids for i in r.ids] == [*tok.encode("𝒳é " * 4000, add_special_tokens=False).ids, 0]


# ---------------------------------------------------------------- fill in the middle


def test_ranks():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 1000):
        x = rng.integers(0, 5, n).astype(np.uint8)
        matrix = fill_in_middle.WaveletMatrix(x, 3)
        at = np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [int((x[:i] == s).sum()) for i in at]


def units(text, unit):
    """Texts of the units; what stands before the first is its own."""
    if unit == "char":
        return list(text)
    at = [m.start() for m in (re.finditer(r"(?<![^ \t\n\v\f\r])[^ \t\n\v\f\r]", text) if unit == "word" else re.finditer(r"(?:(?<=\n)|\A)(?s:.)", text))]
    parts = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=False)]
    if parts:
        parts[0] = text[: at[0]] + parts[0]
    return parts


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle(spark, unit):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "é", "中", "😀", " ", "\n", "\t", "bc", "<", "P>", "<P", "S>"]) for _ in range(rnd.choice([1, 3, 30, 300]))) for _ in range(400)]
    texts += [None, "", " ", "\n\n", "<P>", "x<S>y", "a<M>", "<<S", "é" * 100_000, "word " * 300_000]
    rows = [*enumerate(texts), (3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("h1", F.lit(0))
    out = fill_in_middle.fill_in_middle(df, unit)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    got = Counter(map(tuple, out.withColumn("back", back).collect()))
    want = Counter()
    for i, t in rows:
        t = t or ""
        x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
        u = units(t, unit)
        a, b = sorted(k % (len(u) + 1) for k in h[:2])
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        s = t[len(p) + len(m) :]
        if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
            want[i, len(u), "plain", None, None, t, t] += 1
        elif h[3] % 100 < 20:
            want[i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t] += 1
        else:
            want[i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t] += 1
    assert got == want
    assert fill_in_middle.fill_in_middle(df.limit(0)).collect() == []
