"""Packing, decontamination, classifier, extraction, similarity join and language model against brute force."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragspark.llm import common, decontaminate, html_extract, jaccard_join, packing, pitman_yor, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumn("score", F.lit("x")).withColumn("length", F.lit(1)).withColumn("n", F.lit(0))


def lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


def word(rnd, n=4):
    return "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, n)))


# ---------------------------------------------------------------- packing


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    rows = [(i, " ".join(word(rnd, 9) for _ in range(rnd.choice([3, 50, 400, 2500])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "<|endoftext|> \n\n\t x" + " " * 3000), (5, "again"), (5, "again"), (None, "no id"), (103, "𝒳é" * 4000)]
    got = packing.pack_documents(docs(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            want[i, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(docs(spark, [])).collect() == []


def test_words_have_the_tokens_of_the_text(monkeypatch):
    encoder = packing._encoder(None)
    parts = [" ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u180e", "\u2003", "\u200b", "\u3000", " zymurgy", " 1024", ",", "a", "the", "'s", "'ll", " don't", "23", ".", "!!", "é", "中", "<|endoftext|>", "<|end", "\ufeff", "\u0301", "😀", "\x00", " Ünïcödé", "\nstraße", " ÿ", "\nÀÖ", "...", "-", "$$$", "&*", " ª", "·", "\n7"]
    rng = np.random.default_rng(4)
    monkeypatch.setattr(packing, "_RUN", 5)
    monkeypatch.setattr(encoder, "most", 300)
    for _ in range(3000):
        texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(2)] + [" ".join(rng.choice(parts[12:], rng.integers(0, 9))).strip()]
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoder.encode(texts[0]).tolist() == want[0]
        assert [x.tolist() for x in encoder.encode_all(pa.array(["skipped", *texts])[1:])] == want


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(1)
    for hist in (np.zeros(65, int), rng.integers(0, 50, 65), np.bincount([3] * 1000, minlength=65), np.bincount(rng.integers(1, 65, 20000), minlength=65)):
        hist = hist.copy()
        hist[0] = 0
        used = np.zeros(65, int)
        for parts, times in packing.make_plan(hist, 64):
            assert sum(parts) <= 64 and times > 0
            for n in parts:
                used[n] += times
        assert (used == hist).all()
    rows = packing.make_plan(np.bincount(rng.integers(1, 65, 200000), minlength=65), 64)
    filled = sum(sum(p) * t for p, t in rows)
    assert filled / (64 * sum(t for _, t in rows)) > 0.97


def test_ids_can_be_kept(spark):
    got = packing.pieces(docs(spark, [(1, "a b c")]), with_ids=True).first()
    assert got.length == len(got.ids) and got.ids[-1] == 0


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, names = set(), set()
    for i, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        n = min(10, len(v))
        wins = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if n else set()
        for s in range(len(w) - n + 1):
            if n and tuple(w[s : s + n]) in wins:
                hit.update(range(s, s + n))
                names.add(i)
    return len(w), len(hit), sorted(names, key=str)


def test_decontamination(spark):
    rnd = random.Random(4)
    w = lambda n: " ".join(rnd.choice("ab") + rnd.choice("cd") for _ in range(n))
    items = [(1, w(10)), (2, w(12)), (10, w(25)), (3, "one two"), (4, None), (5, "!!"), (None, w(10)), (6, "Sólo"), (2, w(11)), (7, "a " * 30), (8, w(9))]
    rows = [(i, w(rnd.choice([0, 3, 9, 40, 200]))) for i in range(40)] + [(50 + i, f"X. {w(3)} {t} {w(2)}!") for i, (_, t) in enumerate(items)]
    rows += [(90, None), (91, ""), (92, "ONE-two"), (93, "a " * 200), (94, "one two " + items[0][1][5:]), (7, "sólo"), (7, "sólo"), (None, "one two")]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    for most in (1_000_000, 0):
        got = decontaminate.decontaminate(docs(spark, rows), b, most).collect()
        assert len(got) == len(rows)
        want = Counter((i, *brute_hits(t, items)[:2], tuple(sorted({*brute_hits(t, items)[2]} - {None})), len(brute_hits(t, items)[2])) for i, t in rows)
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.n_items) for r in got) == want
        assert all(sum(x.end - x.first for x in r.hits) == r.n_hit for r in got)
    assert decontaminate.decontaminate(docs(spark, []), b).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs(spark, rows), b.limit(0)).collect())


# ---------------------------------------------------------------- classifier


def test_classifier(spark):
    rnd = random.Random(5)
    good = lambda: " ".join(word(rnd, 8) for _ in range(rnd.randint(20, 300))).capitalize() + "."
    bad = lambda: " ".join(word(rnd, 8).upper() + "!!" for _ in range(rnd.randint(20, 300)))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    extra = [(1000, None), (1001, ""), (1001, ""), (None, "x"), (1002, " \n "), (1003, "y" * 100000)]
    got = quality.classify(docs(spark, rows + extra), labels).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    # labels of the held-out fold teach nothing
    flipped = labels.withColumn("quality", F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs(spark, rows), flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-4 for r in held)
    assert quality.classify(docs(spark, []), labels).collect() == [] and quality.classify(docs(spark, rows[:3]), labels.limit(0)).count() == 3


# ---------------------------------------------------------------- extraction


def test_blocks():
    text = lambda h: "\n".join(t for t, k in html_extract.blocks(h) if k != html_extract.BOILERPLATE)
    assert text("<div class='menu'>a</div><div><p>one &lt;b&gt; two<p>three<br>four</div><form>x</form>") == "one <b> two\nthree four"
    assert text("plain < text &amp; more") == "plain < text & more" and text("<p>cut <b") == "cut" and text("") == ""
    assert text("<main><header><h1>T</h1></header><p>x</p><aside>s</aside><div id=comments><p>c</p></div></main><footer>f</footer>") == "T\nx"
    assert text("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>ye<i>s</i>&nbsp;&#233;</p>") == "yes é"
    assert text('<p title="a>b">x</p><p hidden>y</p><div role="navigation">z</div>') == "x"
    assert text("<" * 20000) and text("<a " * 20000) is not None


def test_shared_is_longest():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = html_extract.shared(a, b)
        assert len(got) == best[-1][-1]
        it = iter(b)
        assert all(any(x == y for y in it) for x in (a[i] for i in sorted(got)))


def test_marks_in_the_article():
    kept = '<article><div id="related-work">a</div><p class="share-prices">b</p><p class="alert-level">c</p><figure class="social-history">d</figure><div class="wide">e</div></article>'
    assert [k for _, k in html_extract.blocks(kept)] == [html_extract.ARTICLE] * 5
    dropped = '<article><div class="wide share-buttons">a</div><div id="cookie_notice">b</div><div class="comments">c</div><p>d</p></article><div class="main-menu">e</div>'
    assert [k for _, k in html_extract.blocks(dropped)] == [html_extract.BOILERPLATE] * 3 + [html_extract.ARTICLE, html_extract.BOILERPLATE]


def test_long_pages_end():
    start = time.time()
    assert len(html_extract.shared([1] * 8000, [1] * 7000 + [2] * 1000)) == 7000
    assert len(html_extract.shared([1, 2] * 4000, [2, 1] * 4000)) == 7999
    html_extract.blocks("<b>x" * 7000 + "</i>" * 14000)
    assert time.time() - start < 4


def test_lost_blocks():
    a, p, x = html_extract.ARTICLE, html_extract.PLAIN, html_extract.BOILERPLATE
    lost = html_extract.lost
    kinds, prints = [x, a, a, a, a, p], [1, 2, 3, 4, 5, 6]
    near, far = [1, 9, 3, 8, 6], [3, 7, 6]
    assert lost(prints, kinds, near, far) == [2, 5]  # both neighbours have 3
    assert lost(prints, kinds, near, [7]) == [5] and lost(prints, kinds, near, None) == [5] and lost(prints, kinds, None, None) == []
    assert lost(prints, kinds, [2, 3, 4, 10], far) == []  # the same story
    assert lost([1, 1], [p, p], [1], None) in ([0], [1])


def test_passages_that_few_pages_quote_stay(spark):
    quote, site = "<p>a passage that a few pages quote</p>", "<p>Sign up for our letter</p>"
    page = lambda n: f"<main><p>story {n}</p><p>more of {n}</p>{quote if n in (3, 4, 5) else ''}<p>end of {n}</p>{site}</main>"
    rows = [(i, f"http://h.example/a/{i:02}", page(i)) for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("a passage" in got[i]) == (i in (3, 4, 5)) for i in range(20))
    assert not any("Sign up" in got[i] for i in range(1, 19))  # the first and the last page have one neighbour
    more = '<main><div class="related-posts">a</div><p class="author-social">b</p><p class="posts">c</p></main><div class="reader-responses">d</div>'
    assert [k for _, k in html_extract.blocks(more)] == [html_extract.BOILERPLATE] * 2 + [html_extract.ARTICLE, html_extract.BOILERPLATE]


def test_differencing(spark):
    page = lambda n: f"<body><div>Site name</div><div>Home of {n}</div><p>story {n}</p><div>All rights</div></body>"
    rows = [(i, f"http://h.example/a/{i}", page(i)) for i in range(5)] + [(10, "http://solo.example/x?y#z", page(9)), (11, None, None), (12, "nonsense", ""), (3, "http://h.example/a/3", page(3))]
    rows.append((20, "http://h.example/a/9", "<nav>Site name</nav><article><p>Site name</p><p>own</p></article><div>All rights</div>"))
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "Home of 1\nstory 1" and by[10] == "Site name\nHome of 9\nstory 9\nAll rights" and by[11] == by[12] == "" and by[20] == "Site name\nown"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    # a line that all articles of a host have is the site's, a story that two pages carry is not
    story = lambda n: f"<article><h1>Title {n}</h1><p>one {n}</p><p>Read more every day</p><p>two {n}</p></article>"
    rows = [(i, f"http://h.example/{i}", story(i)) for i in range(5)] + [(7, "http://h.example/22", story(2))]
    by = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by[1] == "Title 1\none 1\ntwo 1" and "Read more" in by[0] and by[2] == by[7] == "Title 2\none 2\nRead more every day\ntwo 2"


# ---------------------------------------------------------------- similarity join


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), (least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def test_jaccard_join(spark, monkeypatch):
    rnd = random.Random(7)
    rows = []
    hot = [word(rnd) for _ in range(60)]
    for _ in range(40):
        w = [word(rnd) for _ in range(rnd.choice([1, 3, 4, 5, 6, 8, 9, 12, 14, 30, 60, 70, 130, 170]))]
        if rnd.random() < 0.4:
            w = hot[: rnd.choice([9, 30, 60])] + w
        for _ in range(rnd.choice([1, 2, 4])):
            v = list(w)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                v[rnd.randrange(len(v))] = word(rnd)
            rows.append((len(rows), " ".join(v)))
    base = [word(rnd) for _ in range(150)]
    for _ in range(60):  # a chain: each differs from the one before in a few places
        base[rnd.randrange(150)] = word(rnd)
        rows.append((len(rows), " ".join(base)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[3][1].upper()), (3, rows[3][1]), (None, rows[5][1]), (None, "alone is this text here now"), (904, " ".join(hot * 200))]
    rnd.shuffle(rows)
    want = brute_components(rows)
    got = jaccard_join.link(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    # all shingles frequent: combinations only
    monkeypatch.setattr(jaccard_join, "COMMON", 0.02)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link(docs(spark, rows)).collect()) == want
    # more rounds
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link(docs(spark, rows), small=8).collect()) == want
    assert jaccard_join.link(docs(spark, [])).collect() == []


def test_signatures_meet():
    """Similar sets of all sizes share a signature, whatever class each token has; combinations stay in proportion."""
    rnd = random.Random(8)
    for n in [*range(4, 401), 797, 1600, 5000]:
        for _ in range(3):
            x = sorted(rnd.sample(range(10**6), n))
            y = set(x)
            for _ in range(n // 8 + 1):
                y.discard(rnd.choice(x))
                if rnd.random() < 0.5:
                    y.add(rnd.randrange(10**6))
            y = sorted(y)
            both = len(set(x) & set(y))
            if len(y) < 4 or 100 * both < 80 * (len(x) + len(y) - both):
                continue
            choice = rnd.choice([[1], [2], [3], [2, 3], [1, 2, 2, 3, 3]])
            kinds = {t: (rnd.choice(choice), rnd.randint(0, 3)) for t in {*x, *y}}
            sig = [jaccard_join.signatures(np.array(s, np.uint64), np.array([kinds[t][0] for t in s], np.int8), np.array([kinds[t][1] for t in s], np.int8))[0].tolist() for s in (x, y)]
            assert set(sig[0]) & set(sig[1]), (x, y)
            assert len(sig[0]) <= 40 * n


def test_combinations_are_all():
    group = np.array([5, 7, 5, 5, 7, 9, 5])
    for k in (2, 3):
        got = {tuple(c) for c in jaccard_join._chosen(group, k).T.tolist()}
        assert got == {c for c in itertools.combinations(range(7), k) if len({group[i] for i in c}) == 1}
    assert jaccard_join._places(group).tolist() == [0, 0, 1, 2, 1, 0, 3]


def test_sets_of_one_name():
    """A set whose name another one has is renamed by its digest's other half."""
    g, ends = np.arange(9, dtype=np.uint64), np.array([4, 4, 9])
    names, checks = jaccard_join._set_ids(g, ends)
    again, same = jaccard_join._set_ids(g, ends, {(int(names[2]), int(checks[2])): 77, (int(names[0]), 5): 8})
    assert names[1] == 0 and again.tolist() == [names[0], 0, 77] and (same == checks).all()


def test_bitmaps_never_rule_out_too_much():
    rng = np.random.default_rng(3)
    for n in (1, 5, 63, 64, 65, 129, 1000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 8 :], rng.integers(0, 2**63, n // 9).astype(np.uint64)]))
        assert jaccard_join.differing_bits(jaccard_join.bitmap(a), jaccard_join.bitmap(b)) <= len(np.setxor1d(a, b))


# ---------------------------------------------------------------- language model


def test_language_model(spark):
    rnd = random.Random(9)
    common = ["the", "of", "and"]
    rows = [(i, " ".join(rnd.choice([*common, *common, word(rnd)]) for _ in range(rnd.randint(0, 80)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "NEW unseen-word " * 30), (7, "Repeated row"), (7, "Repeated row"), (None, "no id"), (503, "w" * 100000)]
    df = docs(spark, rows).select("doc_id", "text", "lang")
    got = pitman_yor.score_texts(df).collect()
    assert len(got) == len(rows)
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\0end"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t)), 5)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert pitman_yor.score_texts(df.limit(0)).collect() == []


END = "\0end"


def probabilities(spark, m, vocabulary):
    """p(word | word before), and p(word) at the start, for all words and an unknown one, out of scores of one and two words."""
    p0 = {_word(r.h, vocabulary): [r[f"p0_{k}"] for k in range(2)] for r in m.words.collect()}
    start = {w: sum(p) / 2 for w, p in p0.items()} | {"?": sum(m.unknown) / 2}
    known = [w for w in p0 if w != END] + ["?"]
    texts = [" ".join(x) for n in (1, 2) for x in itertools.product(known, repeat=n)]
    got = {r.text_: 10**r.score for r in m.score(spark.createDataFrame([(t, t) for t in texts], "text string, text_ string")).collect()}
    p = {(g, END): got[g] / start[g] for g in known}
    return start, p | {(g, h): got[f"{g} {h}"] / start[g] / p[h, END] for g in known for h in known}


def _hash(w):
    data = np.frombuffer(w.encode(), np.uint8)
    return int(pitman_yor.tokens(data, np.array([0, len(data)]))[0].view(np.int64)[0])


def _word(h, vocabulary):
    return next((w for w in vocabulary if _hash(w) == h), END)


def test_probabilities_sum_to_one(spark):
    """Over all known words and the unknown one, at the start and after each word; also where restaurants are split into parts."""
    rnd = random.Random(10)
    rows = [(i, " ".join(rnd.choice(["a", "b", "c", word(rnd, 2)]) for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = {w for _, t in rows for w in t.split()}
    tables = []
    for bucket in (pitman_yor.BUCKET, 300):
        m = pitman_yor.Model(df, bucket=bucket)
        assert len(m.deal.hot) > 0
        start, p = probabilities(spark, m, vocabulary)
        assert abs(sum(start.values()) - 1) < 1e-9
        for g in {g for g, _ in p}:
            assert abs(sum(x for (a, _), x in p.items() if a == g) - 1) < 1e-9
        tables.append(p)
    assert all(abs(math.log10(tables[0][k] / tables[1][k])) < 0.2 for k in tables[0])


def sequential(texts, d0, d1, theta, uniform, sweeps, burn, rnd):
    """A plain sampler that seats one customer at a time, in restaurants of tables; averaged p(h | g) as a function."""
    rest, parent = {}, Counter()  # (g, h) -> sizes of tables; the parent's: h -> sizes of tables
    tables0 = {}
    customers, n_tables = Counter(), Counter()

    def p_parent(h):
        c, t = sum(tables0.get(h, [])), len(tables0.get(h, []))
        n, k = parent["c"], parent["t"]
        return (c - d0 * t + (theta + d0 * k) * uniform) / (theta + n)

    def sit(sizes, new):
        weights = [*(s - (d0 if sizes is not None and new[1] else d1) for s in sizes), new[0]]
        i = rnd.choices(range(len(weights)), weights)[0]
        if i == len(sizes):
            sizes.append(1)
            return True
        sizes[i] += 1
        return False

    def leave(sizes):
        i = rnd.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        if not sizes[i]:
            sizes.pop(i)
            return True
        return False

    def add0(h):
        new = sit(tables0.setdefault(h, []), ((theta + d0 * parent["t"]) * uniform, True))
        parent["c"] += 1
        parent["t"] += new

    def drop0(h):
        parent["t"] -= leave(tables0[h])
        parent["c"] -= 1

    def add(g, h):
        if g is None:
            return add0(h)
        new = sit(rest.setdefault((g, h), []), ((theta + d1 * n_tables[g]) * p_parent(h), False))
        customers[g] += 1
        if new:
            n_tables[g] += 1
            add0(h)

    def remove(g, h):
        if g is None:
            return drop0(h)
        customers[g] -= 1
        if leave(rest[g, h]):
            n_tables[g] -= 1
            drop0(h)

    pairs = [(g, h) for t in texts for g, h in zip([None, *t], t, strict=False)]
    for g, h in pairs:
        add(g, h)
    total = Counter()
    for sweep in range(sweeps):
        for g, h in pairs:
            remove(g, h)
            add(g, h)
        if sweep >= burn:
            for g in customers:
                for h in tables0:
                    c = rest.get((g, h), [])
                    total[g, h] += (sum(c) - d1 * len(c) + (theta + d1 * n_tables[g]) * p_parent(h)) / (theta + customers[g]) / (sweeps - burn)
    return total


def test_against_a_sequential_sampler(spark):
    rnd = random.Random(13)
    rows = [(i, " ".join(rnd.choice("aaabbbccdefghij") + rnd.choice(["", "", "x"]) for _ in range(25))) for i in range(60)]
    m = pitman_yor.Model(spark.createDataFrame(rows, "doc_id long, text string"))
    vocabulary = {w for _, t in rows for w in t.split()}
    _, p = probabilities(spark, m, vocabulary)
    want = sequential([[*t.split(), END] for _, t in rows], m.z["d0"], m.z["d1"], m.z["theta"], m.z["uniform"], 60, 20, rnd)
    off = [abs(math.log10(p[k] / want[k])) for k in want]
    assert max(off) < 0.25 and sum(off) / len(off) < 0.03
    seen = Counter(x for _, t in rows for x in zip(t.split(), [*t.split()[1:], END], strict=True))
    assert abs(sum(n * math.log10(p[k] / want[k]) for k, n in seen.items())) / sum(seen.values()) < 0.01


def test_rare_contexts(spark):
    """A word that is a small part of the corpus still predicts the word after it."""
    rnd = random.Random(11)
    rows = [(i, " ".join(f"w{rnd.randrange(300)}" for _ in range(40)) + (" rare partner" if i % 8 == 0 else " partner" if i % 8 == 1 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = pitman_yor.Model(df)
    toks = lambda t: [*t.split(), END]
    pairs = Counter(x for _, t in rows for x in zip(toks(t), toks(t)[1:], strict=False))
    told = m.rest.select(F.explode(F.arrays_zip("part", "customers", "n", "single")).alias("x")).select("x.*").collect()
    assert sum(r.customers for r in told) == sum(pairs.values()) and sum(r.n + r.single for r in told) == len(pairs)
    assert len({r.part for r in told}) >= len({g for g, _ in pairs})
    new = spark.createDataFrame([(1, "rare partner"), (2, "unheard partner"), (3, "rare"), (4, "unheard")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in m.score(new).collect()}
    assert (got[1] - got[3]) - (got[2] - got[4]) > 0.5
    # the same scores, however the rows are dealt
    again = {r.doc_id: r.score for r in pitman_yor.Model(df.repartition(7)).score(new.coalesce(1)).collect()}
    assert all(abs(again[k] - got[k]) < 1e-9 for k in got)


def test_tables():
    s = pitman_yor._log_stirling(0.5)
    c = np.array([1, 2, 5, 64, 65, 5000])
    u = np.random.default_rng(0).random((2000, 6))
    t = np.array([pitman_yor.draw_tables(c, np.full(6, 0.01), np.full(6, 10), 0.5, 1.0, s, x) for x in u])
    assert (t >= 1).all() and (t <= c).all() and (t[:, 0] == 1).all()
    # three ways to seat three customers at two tables, each worth 1 - d
    assert abs(math.exp(s[3, 2]) - 1.5) < 1e-9
    # leaps go on from the exact draws
    assert 0.8 < t[:, 4].mean() / t[:, 3].mean() < 1.25


def test_work_of_the_language_model():
    """Tokens are sorted as packed numbers and looked up by their first bits, with the results of plain sorting and searching."""
    rng = np.random.default_rng(5)
    for x in (rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(0, 40, 3000), np.array([5, 2**64 - 1, 4, 0, 5, 2**64 - 1], np.uint64), np.zeros(0, np.int64)):
        assert (common.argsort(x) == np.argsort(x, kind="stable")).all()
        found, order, first = common.unique(x)
        assert found.tolist() == sorted(set(x.tolist())) and (x[order][first] == found).all()
    most = np.append(np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64)), np.uint64(2**64 - 1))
    for t in (most, most[:-1], most[:1], most[:0], most[:-1] >> np.uint64(14), np.arange(7, 90, dtype=np.uint64)):
        asked = np.concatenate([t, rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        where = {w: i for i, w in enumerate(t.tolist())}
        assert common.Places(t).find(asked).tolist() == [where.get(w, -1) for w in asked.tolist()]


def test_hashes_of_words():
    """A running sum over the slice gives what each word alone would, also beyond the powers that are kept."""
    base, full = int(common._BASE), 1 << 64
    for text in (b"Ab \xc3\xa9b ab\x0bb", b" x" * 9 + b"y", b"w" * 70 + b" " + b"v" * ((1 << 20) + 3) + b" Ab"):
        h, starts, ends, _ = common.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), common.SPACED)
        for i in {0, len(h) // 2, len(h) - 1}:
            word = text[starts[i] : ends[i]].lower()
            if len(word) < 99:
                sum_ = sum(int(common._BYTE[b]) * pow(base, k + 1, full) for k, b in enumerate(word)) + len(word)
                assert h[i] == common.mix(np.array([sum_ % full], np.uint64))[0]


def test_tables_by_weights():
    """Dishes drawn together get what their own weights say, in logarithms, also where these are too large for plain numbers."""
    rng, d, theta = np.random.default_rng(8), 0.7, 1.0
    s = pitman_yor._log_stirling(d)
    c = rng.integers(0, 65, 4000)
    base, others, u = 10.0 ** rng.uniform(-9, 0, 4000), rng.integers(0, 10**9, 4000) * rng.integers(0, 2, 4000), rng.random(4000)
    got = pitman_yor.draw_tables(c, base, others, d, theta, s, u)
    for n, b, o, x, t in zip(c.tolist(), base, others, u, got.tolist(), strict=True):
        if n < 2:
            assert t == n
            continue
        weight = s[n, 1 : n + 1] + np.cumsum(np.log(theta + d * (o + np.arange(n))) + np.log(b))
        share = np.cumsum(np.exp(weight - weight.max()))
        near = np.abs(share / share[-1] - x).min() < 1e-9
        assert near or t == 1 + (share < x * share[-1]).sum()


def test_look_up_in_a_range():
    """Parts of a bucket share their first bits; each is found in a few steps all the same."""
    rng = np.random.default_rng(6)
    t = np.unique(np.uint64(5 << 60) + rng.integers(0, 1 << 48, 20000, dtype=np.uint64))
    p = common.Places(t)
    assert (p.find(t) == np.arange(len(t))).all()
    assert np.diff(p.first).max() < 20
    x = np.repeat(t, 3)
    assert (common.argsort(x) == np.argsort(x, kind="stable")).all()
