"""PII, sharding, chat formatting and exact dedup against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

from pyspark.sql import functions as F

from ragspark.llm import chat_format, exact_dedup, pii, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None), (2, ""), (3, "a@b.co x@y"), (3, "a@b.co x@y"), (4, "mail a.b+c@d-e.org_x@y.io, 1.2.3.4.5.6.7.8 and 300.1.1.1 0001.2.3.255"), (None, "+1 (017) 555-7713 +12 3456789 ++49 30 1234567890123"),
    (5, "4111 1111 1111 1111 4111-1111-1111-1112 9807915762804490 12345678901234567890123"), (6, "é𝒳 +1 (017) 555-7713é a@b.c.d."), (7, "x" * 30000 + "@y.z"), (8, "1" * 20000), (9, "9.9.9.9 " * 500), (10, "a@" + "b." * 3000 + "c"),
]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    return df.withColumn("kept", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("size", F.lit(2)).withColumn("spans", F.lit(3)) if extra else df


def luhn(s):
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if (m.end() - m.start() < 4000 or name == "email") and ok(m.group()))
    return [(n, a, b) for a, _, b, n in found]


def test_base_spans(spark):
    got = pii.find_private(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    want = sorted((str(i), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(t)).encode()).hexdigest(), sum(k == "phone" for k, _, _ in base(t))) for i, t in ODD)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_phone) for r in got) == want
    assert pii.find_private(docs(spark, [])).collect() == []


def test_disclosing_terms(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(400)]
    rows += [(1000 + i, " ".join(word() for _ in range(12)) + f" Zorbanax of desk {i} is boss@corp.example " + " ".join(word() for _ in range(12))) for i in range(5)]
    rows += [(2000, "we met Zorbanax again"), (2001, "a copied secretword of spy@corp.example")] + [(2100 + i, "a copied secretword of spy@corp.example") for i in range(5)]
    found = {r.doc_id: r for r in pii.find_private(docs(spark, rows)).collect()}
    assert found[2000].spans == "term:7:15" and found[1000].n_email == 1 and "term" in found[1000].spans
    assert n_terms(found[2001]) == 0  # copies are one text
    assert sum(n_terms(found[i]) for i in range(400)) == 0
    texts = pii.sanitised(docs(spark, rows), pii.find_private(docs(spark, rows)))
    text = {r.doc_id: r.sanitised for r in texts.collect()}
    assert text[2000] == "we met  again" and text[0] == rows[0][1] and "[EMAIL]" in text[1000]


def n_terms(r):
    return r.n_generalised + r.n_removed


def test_rewritten(spark):
    """Against a loop, with spans that overlap and a text of several blocks."""
    rnd = random.Random(5)
    rows = []
    for n in (0, 1, 30, 700):
        text = "".join(rnd.choice("abcé𝒳") for _ in range(9000))
        starts = sorted(rnd.randrange(9000) for _ in range(n))
        rows.append((text, [(a, rnd.randrange(6), min(9000, a + rnd.randint(1, 40)), None) for a in starts]))
    rows += [("", []), ("abc", [(0, 0, 3, None)]), ("abc", [(0, 5, 1, None), (2, 4, 3, None)])]
    df = spark.createDataFrame(rows, "text string, found array<struct<start:int,kind:int,end:int,value:string>>")
    labels = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]
    for (text, found), r in zip(rows, df.select(pii.rewritten(F.col("text"), F.col("found")).alias("t")).collect(), strict=True):
        want, at = "", 0
        for a, k, b, _ in found:
            if a >= at:
                want += text[at:a] + labels[k]
            at = max(at, b)
        assert r.t == want + text[at:]


def test_many_matches(spark):
    text = " ".join(f"{i % 256}.{i // 256 % 256}.1.2" for i in range(50000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    r = df.select(pii.base_spans(F.col("text"), 120).alias("x")).select(F.size("x").alias("n"), F.element_at("x", -1).alias("last")).first()
    assert r.n == 50000 and text[r.last.start : r.last.end] == r.last.value
    assert time.time() - start < 20


def test_disclosure_ratio(spark):
    """The ratio of every term near every entity by its formula."""
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    some = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    rows = [(i, some(30)) for i in range(300)]
    rows += [(1000 + i, f"{some(15)} Alpha e{i % 3}@x.org {'Beta' if i % 2 else 'Gamma'} {some(15)}") for i in range(24)] + [(2000 + i, f"{some(9)} beta {some(9)}") for i in range(9)]
    words = {i: set(re.findall(r"[^\W\d_]{3,}", t.lower())) for i, t in rows}
    near, holds = {}, {}
    for i, t in rows:
        for m in re.finditer(r"e\d@x.org", t):
            holds.setdefault(m.group(), set()).add(i)
            for w in re.findall(r"[^\W\d_]{3,}", (t[: m.start()][-120:] + " " + t[m.end() :][:120]).lower()):
                near.setdefault((w, m.group()), set()).add(i)
    want, u = {}, len(rows)
    for (w, e), x in near.items():
        if len(x) >= 3:
            n_t, n_e = sum(w in v for v in words.values()), len(holds[e])
            want[w] = max(want.get(w, -9), math.log2(len(x) * u / (n_t * n_e)) / math.log2(max(u / n_e, 2)))
    df = docs(spark, rows, False).select("doc_id", "text")
    spans = df.select(F.xxhash64("text").alias("_text"), F.explode(pii.base_spans(F.col("text"), 120)).alias("x")).select("x.kind", "x.value", "x.near", "_text")
    got = {r.term: r.ratio for r in pii.disclosing_terms(spans, df, 3, -9.0, 0.9, 1000).collect()}
    assert got.keys() == want.keys() and {"alpha", "beta", "gamma"} <= got.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_copies_are_no_evidence_against_a_term(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, 60)) for i in range(400)]
    rows += [(1000 + i, f"{prose(rnd, 12)} Zorbanax x{i} boss@corp.example {prose(rnd, 12)}") for i in range(4)]
    rows += [(2000 + i, rows[-1][1]) for i in range(1000)]
    found = {r.doc_id: r for r in pii.find_private(docs(spark, rows)).collect()}
    assert n_terms(found[1000]) == 1 and n_terms(found[2000]) == 1


def test_fixed_phrases_disclose_and_near_copies_do_not(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, 60)) for i in range(400)]
    rows += [(1000 + i, f"{prose(rnd, 40)} Sales desk, Anna Zorbanax, Berlin office: x@corp.example {prose(rnd, 40)}") for i in range(20)]
    whole = prose(rnd, 100).split()
    for i in range(20):
        w = list(whole)
        for _ in range(4):
            w[rnd.randrange(100)] = prose(rnd, 1)
        rows.append((2000 + i, " ".join([*w[:50], "spy@corp.example", *w[50:]])))
    found = {r.doc_id: r for r in pii.find_private(docs(spark, rows)).collect()}
    assert all(n_terms(found[1000 + i]) >= 6 for i in range(20))
    assert sum(n_terms(found[i]) for i in found if i >= 2000 or i < 400) == 0


def test_near_copies_are_found(spark):
    """Against all pairs: of those that share four fifths of their word pairs nine in ten are in one group, of unlike texts none."""
    rnd = random.Random(11)
    texts = []
    for k in range(120):
        whole = prose(rnd, rnd.choice([12, 40, 150, 400])).split()
        for _ in range(rnd.choice([1, 3, 6])):
            w = list(whole)
            for _ in range(rnd.randint(0, max(1, len(w) // 12))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            texts.append((k, " ".join(w)))
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    group = {r._text: r._group for r in pii.near_copies(df, 1000).collect()}
    name = [group.get(hashes[i], hashes[i]) for i in range(len(texts))]
    sets = [set(zip(w, w[1:], strict=False)) for w in (t.lower().split() for _, t in texts)]
    near, found = 0, 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                near += 1
                found += name[i] == name[j]
            assert texts[i][0] == texts[j][0] or name[i] != name[j]
    assert near > 200 and found >= 0.9 * near, (found, near)


def test_terms_are_generalised_or_removed(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, 60)) for i in range(200)]
    rows += [(1000 + i, f"{prose(rnd, 12)} Zorbanax x{i} boss@corp.example {'Quibble' if i < 4 else 'x'} {prose(rnd, 12)}") for i in range(5)]
    rows += [(2000 + i, f"{prose(rnd, 9)} Quibble {i}") for i in range(1)]
    both = docs(spark, rows)
    found = pii.find_private(both, generalise=0.75, remove=0.95)
    text = pii.sanitised(both, found).where("doc_id = 1000").first().sanitised
    assert "Zorbanax" not in text and "  x0 [EMAIL] [TERM] " in text


def test_long_chain_of_calls(spark):
    n = 67
    rows = [(1, n - i, f"c{i}", "search", "{}", [f"c{i - 1}"] if i else []) for i in range(n)] + [(1, 100, "x", "search", "{}", ["x"])]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, tool string, arguments string, after array<string>").coalesce(1)
    got = chat_format.link_calls(calls, spark.createDataFrame([], "call_id string, content string")).collect()
    assert {r.call_id: (r.level, r.place) for r in got} == {"x": (None, n)} | {f"c{i}": (i, i) for i in range(n)}


def brute_capacity(sizes, shards):
    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def test_minimax_cuts(spark):
    rnd = random.Random(2)
    for n, big in ((1, 1), (5, 1), (300, 1), (300, 5000), (2000, 3)):
        groups = sorted((rnd.getrandbits(60), rnd.randint(1, 100) * (big if i == 7 else 1)) for i in range(n))
        df = spark.createDataFrame(groups, "_key long, _bytes long").cache()
        for bits, most in ((14, 1 << 16), (2, 16)):
            capacity, cuts = sharding.minimax_cuts(df, 4, bits, most)
            assert capacity == brute_capacity([s for _, s in groups], 4)
            sums = [0] * 5
            for k, s in groups:
                sums[sum(k >= c for c in cuts)] += s
            assert max(sums) <= capacity and sums[4] == 0


def test_shards(spark):
    rows = [(i, f"text {i % 90} " * (i % 90)) for i in range(300)] + [(500, None), (501, ""), (7, "text 7 " * 7), (None, "z")]
    got = sharding.shard_by_bytes(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    home = {}
    for r in got:
        home.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in home.values())
    assert sharding.shard_by_bytes(docs(spark, [])).collect() == []


def test_exact_dedup(spark):
    rows = [(3, "a b"), (2, "a  b"), (9, "ab"), (4, "a\tb\x0b\x0c\r\n"), (5, None), (1, ""), (8, " "), (None, "solo"), (7, "x" * 50000), (6, "x" * 50000 + " "), (6, "x" * 50000 + " "), (10, "a b")]
    for runs, fan_in in ((256, 16), (8, 2), (1, 2)):
        got = exact_dedup.mark_duplicates(docs(spark, rows), runs, fan_in).collect()
        assert len(got) == len(rows)
        groups = {}
        for i, t in rows:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
        for r in got:
            g = next(g for p, g in groups.items() if hashlib.sha256(p.encode()).hexdigest() == r.text_sha256)
            assert r.group_size == len(g) and r.keep_id == min(g)[3]
            assert not r.kept or r.doc_id == min(g)[3]
        # one row of each group stays, whatever repeats
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter({r.text_sha256 for r in got})
    assert exact_dedup.mark_duplicates(docs(spark, [])).collect() == []


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "search", '{"limit": 3, "query": "q"}', []), (1, 1, "b", "translate", '{"text":"x"}', ["a", "gone"]), (1, 2, "c", "count", '{"text": 5}', ["b", "a"]), (1, 3, "d", "nope", "[1]", ["d"]),
        (1, 4, "e", "search", "bad", ["f"]), (1, 5, "f", "search", None, ["e"]), (2, 0, None, "count", '{"text":"é\\n"}', None), (1, 9, "a", "count", '{"text":"again"}', []),
    ]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, after array<string>").withColumn("level", F.lit(9))
    r = spark.createDataFrame([("a", "z"), ("a", "y"), ("c", None), (None, "n")], "call_id string, content string")
    got = {(x.conv_id, x.turn): x for x in chat_format.link_calls(c, r, block=2).collect()}
    assert [got[1, t].level for t in (0, 1, 2, 3, 4, 5, 9)] == [0, 1, 2, None, None, None, 0]
    assert sorted(x.place for k, x in got.items() if k[0] == 1) == list(range(7))
    assert got[1, 0].place < got[1, 1].place < got[1, 2].place < got[1, 3].place
    assert got[1, 0].valid and got[1, 0].linked and got[1, 0].call_json == '{"arguments":{"limit":3,"query":"q"},"id":"a","result":"y","tool":"search"}'
    assert got[1, 1].problems == "to: missing" and got[1, 2].problems == "text: not STRING" and "unknown tool" in got[1, 3].problems and got[1, 4].problems == "not an object"
    assert '"arguments":"bad"' in got[1, 4].call_json and '"arguments":null' in got[1, 5].call_json
    assert got[1, 2].linked and not got[1, 1].linked and not got[2, 0].linked
    assert chat_format.link_calls(c.limit(0), r.limit(0)).collect() == []


def test_calls_of_turns(spark):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f'say "{t}"') for t in range(40)] + [(2, 0, "system", None), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    got = chat_format.link_calls(*chat_format.calls_of_turns(turns)).collect()
    assert len(got) == 22 and {r.role for r in got} == {"user", "system"} and max(r.level for r in got) == 4 and all(r.linked for r in got if r.conv_id == 1)
    assert all(r.level == bin(r.turn // 2).count("1") for r in got if r.conv_id == 1)
