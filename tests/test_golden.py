"""Literal cases of behaviour that the tables don't hold: CJK, Markdown, question-answer files, resumes, reports."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators import chunking, conversation, evaluation, planning, retrieval, structure
from ragspark.sources import files, goldset, qa, sinks


def lines(spark, text, doc=1):
    return structure.lines_of(spark.createDataFrame([(doc, text)], "document_id long, text string"))


def test_search_tokens(spark):
    got = spark.createDataFrame([("上线 Go_1é日",)], "t string").select(T.search_tokens(F.col("t"))).first()[0]
    assert got == ["上", "线", "上线", "go_1", "日"]
    assert spark.createDataFrame([("", None)], "t string, u string").select(T.query_terms(F.col("t")), T.query_terms(F.col("u"))).first()[:] == (None, None)


def test_garbled(spark):
    rows = spark.createDataFrame([("ab",), ("A clean sentence of text.",), ("" * 10,), ("(cid:12)" * 10,)], "t string")
    assert [r[0] for r in rows.select(T.garbled(F.col("t"))).collect()] == [True, False, True, True]


def test_mask_and_email(spark):
    rows = spark.createDataFrame([(" ",), ("abcd",), ("secret-1234",), (None,)], "k string")
    assert [r[0] for r in rows.select(T.masked(F.col("k"))).collect()] == ["", "****", "****1234", ""]


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, list_no int, rank int, chunk_id long, score double, image_key string")


def test_rrf(spark):
    got = retrieval.rrf_fusion(_hits(spark, [(1, 0, 1, 1, 0.9, ""), (1, 0, 2, 2, 0.8, ""), (1, 1, 1, 2, 0.1, "k"), (1, 1, 2, 3, 0.1, "")]), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1] and got[0].score == 0.8 and got[0].image_key == "k"


def test_hybrid(spark):
    schema = "case_id long, query_no int, rank int, chunk_id long, score double"
    v = spark.createDataFrame([(1, 1, 1, 1, 0.9), (1, 1, 2, 2, 0.8), (1, 2, 1, 3, 0.9), (1, 2, 2, 4, 0.8)], schema)
    t = spark.createDataFrame([(1, 1, 1, 2, 0.1), (1, 1, 2, 3, 0.1), (1, 2, 1, 3, 0.1), (1, 2, 2, 1, 0.1)], schema)
    assert [r.chunk_id for r in retrieval.hybrid_search(v, t, 3).orderBy("rank").collect()][0] == 3
    v = spark.createDataFrame([(1, 1, 1, 1, 0.9, True), (1, 2, 1, 2, 0.9, False)], schema + ", fulltext_ok boolean")
    t = spark.createDataFrame([(1, 1, 1, 3, 0.1), (1, 2, 1, 9, 0.1)], schema)
    assert sorted(r.chunk_id for r in retrieval.hybrid_search(v, t, 3).collect()) == [1, 2, 3]


def test_normalize_queries(spark):
    q = spark.createDataFrame([(1, 0, " 原问题 "), (1, 1, "子问题"), (1, 2, "原问题"), (1, 3, " ")], "case_id long, pos int, query string")
    assert [r.query for r in retrieval.normalize_queries(q).orderBy("query_no").collect()] == ["原问题", "子问题"]


@pytest.mark.parametrize(
    ("response", "most", "kind", "queries", "fallback"),
    [
        ('{"queryType":"direct","queries":["x"]}', 4, "direct", ["问"], False),
        ('{"queryType":"none","queries":[]}', 4, "none", [], False),
        ('```json\n{"queryType":"contextual_rewrite","queries":["改写"]}\n```', 4, "contextual_rewrite", ["问", "改写"], False),
        ('{"queryType":"decomposition","queries":["架构","架构","配置","测试","部署"]}', 3, "decomposition", ["问", "架构", "配置", "测试"], False),
        ("no json", 4, "direct", ["问"], True),
        ('{"queryType":"hyde","queries":[]}', 4, "direct", ["问"], True),
        ('{"queryType":"contextual_rewrite","queries":[" "]}', 4, "direct", ["问"], True),
        ('{"queryType":"decomposition","queries":["a","A"]}', 4, "direct", ["问"], True),
        (json.dumps({"queryType": "contextual_rewrite", "queries": ["x" * 201]}), 4, "direct", ["问"], True),
        (None, 4, "direct", ["问"], True),
    ],
)
def test_query_plan(spark, response, most, kind, queries, fallback):
    c = spark.createDataFrame([(1, "问", response)], "case_id long, question string, response string")
    r = planning.query_plan(c, most).first()
    assert (r.query_type, r.queries, r.fallback) == (kind, queries, fallback)


def test_citations(spark):
    a = spark.createDataFrame([(1, "x [1] y [4][9]")], "message_id long, content string")
    h = spark.createDataFrame([(1, n, n * 10, 0.5) for n in (1, 2, 4)], "message_id long, rank int, chunk_id long, score double")
    assert sorted(r.position for r in conversation.citations(a, h).collect()) == [1, 4]


def test_history_skips_blank_messages(spark):
    m = spark.createDataFrame([(1, i, "user", " " if i == 2 else f"m{i}") for i in range(1, 15)], "session_id long, id long, role string, content string")
    got = {r.id: [x.content for x in r.history] for r in conversation.chat_history(m).collect()}
    assert got[1] == [] and got[2] == ["m1"] and got[4] == ["m1", "m3"] and got[14] == [f"m{i}" for i in range(4, 14)]


def test_evidence_metrics(spark):
    e = spark.createDataFrame([(1, 0, "A.md", ["x", "Y"]), (1, 1, "b.md", ["z"])], "case_id long, evidence_no int, document_name string, contains array<string>")
    h = spark.createDataFrame([(1, 1, 1, "o.md", "x y z"), (1, 2, 2, " a.MD", "xx yy"), (1, 3, 3, "a.md", "x y"), (1, 4, 4, "B.md", "Z")], "case_id long, rank int, chunk_id long, document_name string, content string")
    r = evaluation.evidence_metrics(e, evaluation.evidence_match(e, h)).first()
    assert (r.hit_at_1, r.hit_at_3, r.hit_at_5, r.recall_at_5, r.mrr_at_10, r.missing) == (0, 1, 1, 1, 0.5, 0)


def test_latency(spark):
    r = spark.createDataFrame([(float(x), 0.0, float(x), False) for x in (50, 10, 30, 20)], "route_ms double, retrieval_ms double, total_ms double, retrieval_performed boolean")
    got = {x.stage: x for x in evaluation.latency_stats(r).collect()}
    assert (got["route"].mean_ms, got["route"].p50_ms, got["route"].p95_ms) == (27.5, 20, 50) and got["retrieval"].mean_ms == 0


def test_nearest_ranks(spark):
    rnd = random.Random(8)
    groups = {"same": [3.0] * 50, "one": [7.5], "two": [1.0, 2.0], "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) for _ in range(400)], "many": [rnd.gauss(0, 1) for _ in range(900)], "ties": [float(rnd.randint(0, 5)) for _ in range(700)], "ends": [-1.7e308, 1.7e308] * 40}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None), ("two", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ps = [0.0, 0.01, 0.5, 0.95, 1.0]
    for bins, most in ((64, 20), (1024, 4096)):
        got = {(r.g, r.p): r.v for r in evaluation.nearest_ranks(df, ["g"], "v", ps, bins, most).collect()}
        assert got == {(g, p): sorted(vs)[max(1, math.ceil(round(p * len(vs), 6))) - 1] for g, vs in groups.items() for p in ps}


def test_sections(spark):
    book = structure.section_paths(lines(spark, "第一章 起点\n开篇正文\n第一节 背景\n背景正文"), "book").orderBy("section_no").collect()
    assert [(r.section_path, r.text) for r in book] == [("第一章 起点", "开篇正文"), ("第一章 起点 / 第一节 背景", "背景正文")]
    paper = structure.section_paths(lines(spark, "Abstract\nshort\n1 Introduction\none\n\n\ntwo\n1.1 Background\nbody"), "paper").orderBy("section_no").collect()
    assert [r.section_path for r in paper] == ["Abstract", "1 Introduction", "1 Introduction / 1.1 Background"]
    assert paper[0].no_split and not paper[1].no_split and paper[1].text == "one\n\ntwo"


def _documents(spark, name, text):
    return spark.createDataFrame([(1, 7, name, text)], "document_id long, dataset_id int, name string, text string")


def test_chunks_of_paper_and_qa(spark):
    got = chunking.build_chunks(_documents(spark, "a.txt", "1 Introduction\n正文内容"), "paper").first()
    assert got.content == "1 Introduction\n\n正文内容" and got.chunk_index == 0 and got.chunk_id > 0
    got = chunking.build_chunks(_documents(spark, "a.txt", "问题一\t答案第一行\n答案第二行\n问题二\t答案二"), "qa").orderBy("chunk_index").collect()
    assert [r.embed_text for r in got] == ["a.txt\n问题一", "a.txt\n问题二"]


def test_qa(spark):
    d = spark.createDataFrame([(1, "问题一\t答案第一行\n答案第二行\n问题二\t答案二")], "document_id long, text string")
    got = qa.qa_delimited(d).orderBy("pair_no").collect()
    assert [(r.question, r.answer) for r in got] == [("问题一", "答案第一行\n答案第二行"), ("问题二", "答案二")]
    d = spark.createDataFrame([(1, 'q1,"a, ""b"""\nq2,c')], "document_id long, text string")
    assert [(r.question, r.answer) for r in qa.qa_delimited(d).orderBy("pair_no").collect()] == [("q1", 'a, "b"'), ("q2", "c")]
    row = spark.createDataFrame([(["问题一", "", "答案一", "忽略"],), (["x", " "],)], "cells array<string>")
    assert [r[:] for r in structure.qa_table_rows(row).collect()] == [("问题一", "答案一")]
    got = structure.qa_headings(lines(spark, "# 账户\n说明\n## 如何重置密码？\n```\n# no\n```\n点这里\n## 空\n## 完\n是")).orderBy("pair_no").collect()
    assert [r.question for r in got] == ["账户", "账户\n如何重置密码？", "账户\n完"]
    got = structure.qa_question_lines(lines(spark, "前言\n1. 如何退款\n答：联系客服\n2. 多久到账\n三天")).orderBy("pair_no").collect()
    assert [(r.question, r.answer) for r in got] == [("如何退款", "联系客服"), ("多久到账", "三天")]


def test_markdown(spark):
    text = "before ![i](a.png) after\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\n| x | y |\n|---|---|\n```\n<table>\n<tr><td>1</td></tr>\n</table>\nend"
    got = chunking.markdown_atoms(spark.createDataFrame([(1, text), (2, None)], "document_id long, text string")).orderBy("atom_index").collect()
    assert [r.element_type for r in got] == ["text", "image", "text", "table", "text", "table", "text"]
    assert got[4].text.startswith("```") and [r.atom_index for r in got] == list(range(7))
    rows = structure.pipe_tables(lines(spark, text)).orderBy("line_no").collect()
    assert [r.cells for r in rows][:2] == [["a", "b"], ["1", "2"]]
    parts = structure.inline_images(spark.createDataFrame([("a ![x](data:image/png;base64,AA) b",)], "text string")).orderBy("part_no").collect()
    assert [(r.element_type, r.is_data) for r in parts] == [("text", False), ("image", True), ("text", False)]


def test_tables_are_split_with_their_header():
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(40))
    parts = chunking.table_parts(table, 80)
    assert len(parts) > 2 and all(p.startswith("| a | b |\n|---|---|\n") for p in parts)
    html = "<table><caption>C</caption><tr><th>h</th></tr>" + "".join(f"<tr><td>{i} {'x' * 20}</td></tr>" for i in range(8)) + "</table>"
    parts = chunking.table_parts(html, 150)
    assert len(parts) >= 2 and all("<caption>C</caption>" in p and "<th>h</th>" in p and p.endswith("</table>") for p in parts)
    assert chunking.table_parts("<table>no rows here</table>", 10) == ["<table>no rows here</table>"]


def test_splitter():
    text = ("一句话。" * 60 + "\n") * 5 + "x" * 700
    parts = chunking.split_text(text)
    assert all(len(p) <= 562 for p in parts) and parts[1].startswith(parts[0][-50:].strip()[:5])
    assert chunking.split_text("  ") == [] and chunking.split_text(" a ") == ["a"]
    for c in set(text) - {"\n"}:
        assert any(c in p for p in parts)


def test_splitter_keeps_its_rule():
    """Without overlap: nothing is lost, a chunk ends at the last cut that fits, finer cuts only where coarser ones don't fit."""
    rnd = random.Random(1)
    for _ in range(1500):
        text = "".join(rnd.choice(["a", "bc", "\n", "\n", "\n\n", " ", "。", "，", "x" * 9]) for _ in range(rnd.randint(0, 60)))
        for target in (5, 12, 30):
            parts = chunking.split_text(text, target, 0)
            assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text) and all(0 < len(p) <= target for p in parts)
            # the first cut: the longest beginning that ends with the coarsest separator and fits
            whole = text.strip()
            sep = next((x for x in chunking.SEPARATORS if not x or x in whole), "")
            if len(whole) > target and sep:
                ends = [sum(len(y) + len(sep) for y in whole.split(sep)[: k + 1]) for k in range(whole.count(sep))]
                first = max([e for e in ends if e <= target], default=ends[0])
                assert "".join(re.sub(r"\s", "", p) for p in parts).startswith(re.sub(r"\s", "", whole[:first]))
                if first <= target and whole[:first].strip():
                    assert parts[0] == whole[:first].strip()
    # separators don't overlap: of three line ends the first two are one, the third begins the next piece
    assert chunking.split_text("aaaa\n\n\nbbbb\n\n\ncc", 8, 0) == ["aaaa", "bbbb", "cc"]
    assert chunking.split_text("aaa bbb ccc ddd", 8, 3) == ["aaa bbb", "bbbccc", "cccddd"]


def test_tables_that_stay_whole():
    rows = "".join(f"<tr><td>{i}</td></tr>" for i in range(20))
    for whole in (f"<table>{rows}<table>{rows}</table></table>", f"<table>{rows}", "<table>" + rows.replace("td", "th") + "</table>"):
        assert chunking.table_parts(whole, 40) == [whole]
    lines = ["| a | b |", "|---|---|", *(f"| {'y' * (i % 7)} | {i} |" for i in range(50))]
    parts = chunking.table_parts("\n".join(lines), 90)
    assert [x for p in parts for x in p.split("\n")[2:]] == lines[2:] and all(len(p) <= 90 for p in parts)
    for p, q in zip(parts, parts[1:], strict=False):
        assert len(p) + 1 + len(q.split("\n")[2]) > 90


def test_lines(spark):
    pages = spark.createDataFrame([(1, p, n, t) for p in (1, 2, 3) for n, t in enumerate(["Head", f"body {p}", "Foot"])], "document_id long, page int, line_no int, line string")
    assert sorted(r.line for r in structure.strip_running_lines(pages).collect()) == ["body 1", "body 2", "body 3"]
    d = spark.createDataFrame([(["computa-", "tion a"],), (["English-to-", "german x"],), (["a --", "b"],), (["one-", "two-", "three"],), ([],), (["Eng-", "German x"],), (["computa-", "tion, and"],), (["well-known-", "ness here"],), (["English-", "to-German"],), (["x-", "", "y"],)], "l array<string>")
    got = [r[0] for r in d.select(structure.dehyphenate(F.col("l"))).collect()]
    assert got == [["computation a"], ["English-togerman x"], ["a --", "b"], ["one-twothree"], [], ["Eng-German x"], ["computa-tion, and"], ["well-knownness here"], ["English-to-German"], ["x-", "", "y"]]


def test_resume(spark):
    text = "张三\n13800138000 a@b.com\n项目经历\n1. 项目甲\n细节\n2. 项目乙\n细节\n教育经历\n大学 2010-2014"
    got = structure.resume_sections(lines(spark, text)).orderBy("entry_no").collect()
    assert [r.section for r in got] == ["基本信息", "项目经历", "项目经历", "教育背景"] and got[1].text == "1. 项目甲\n细节"
    more = "Profile\nAnn Lee\nObjective chief\n+86 13912345678\nWORK EXPERIENCE :\n2010-2012 A\ndid\n2013/1 to present B\nskills\n1. one\n2. two\n工作经历\nlast\nlast"
    got = structure.resume_sections(lines(spark, more)).orderBy("entry_no").collect()
    assert [(r.section, r.text) for r in got] == [("基本信息", "Ann Lee\nObjective chief\n+86 13912345678"), ("工作经历", "2010-2012 A\ndid"), ("工作经历", "2013/1 to present B\nlast"), ("专业技能", "1. one\n2. two")]
    c = structure.contact_entities(lines(spark, more)).first()
    assert (c.name, c.phone, c.intent) == ("Ann Lee", "+86 13912345678", "chief")
    assert structure.contact_entities(lines(spark, "a:1\nskills\nBob")).first().name is None and structure.contact_entities(lines(spark, "a:1\nskills\nBob"), everywhere=True).first().name == "Bob"
    c = structure.contact_entities(lines(spark, text)).first()
    assert (c.name, c.phone, c.email) == ("张三", "13800138000", "a@b.com")
    given = spark.createDataFrame([(1, "李四", "13800138000")], "document_id long, name string, phone string")
    texts = spark.createDataFrame([(1, text)], "document_id long, text string")
    v = structure.verify_entities(given, texts, structure.contact_entities(lines(spark, text)), ["name", "phone"]).first()
    assert (v.name, v.phone) == ("张三", "13800138000")
    sel = spark.createDataFrame([(1, json.dumps([{"type": "basic", "title": "", "lines": [0, 1, 99]}, {"type": "project", "title": "P", "lines": [1, 3]}]))], "document_id long, response string")
    got = structure.claim_lines(lines(spark, text), sel).orderBy("group_no").collect()
    assert [r.type for r in got] == ["basic", "project", "other"] and got[0].title == "张三" and got[1].text == "1. 项目甲"


def test_gold_cases(spark, tmp_path):
    good = {"id": "a", "datasetId": 1, "history": [{"role": "user", "content": "x"}], "question": "q", "expectedRoute": "direct", "relevantEvidence": [{"documentName": "d", "contains": ["m"]}]}
    rows = [good, good, good | {"id": "b", "expectedRoute": "hyde"}, good | {"id": "c", "relevantEvidence": []}, good | {"id": "d", "expectNoEvidence": True}, good | {"id": "e", "datasetId": 0}]
    text = "\n".join(json.dumps(r) for r in rows) + "\n\n{bad\n"
    (tmp_path / "g.jsonl").write_text(text)
    got = goldset.parse_cases(spark.read.text(str(tmp_path))).collect()
    errors = sorted(e for r in got for e in r.errors)
    assert errors == ["bad JSON", "contradictory evidence", "duplicate id", "no dataset", "no evidence declared", "unknown route"]
    with pytest.raises(ValueError, match="invalid"):
        goldset.load_cases(spark, str(tmp_path))
    assert [r.id for r in goldset.load_cases(spark, str(tmp_path), strict=False).collect()] == ["a"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿hé".encode())
    (tmp_path / "b.md").write_bytes(b"\xff\xfe" + "héllo".encode("utf-16-le"))
    (tmp_path / "c.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "d.csv").write_text("x,y")
    (tmp_path / "e.exe").write_text("x")
    good, bad = files.read_corpus(spark, str(tmp_path))
    assert {r.name: r.text for r in good.collect()} == {"a.txt": "hé", "b.md": "héllo", "c.txt": "中文"}
    assert sorted(r.reason for r in bad.collect()) == ["CSV files are for the qa template", "unknown type"]
    assert files.read_corpus(spark, str(tmp_path), "qa")[0].count() == 4


def test_layout(spark):
    items = [
        {"type": "text", "text": "T", "text_level": 2, "page_idx": 0}, {"type": "table", "table_caption": ["c"], "table_body": "<table/>", "table_footnote": ["f"], "page_idx": 1},
        {"type": "header", "text": "h"}, {"type": "image", "image_caption": ["cap"]}, {"type": "code", "code_body": "x=1"}, {"type": "list", "list_items": ["a", " ", "b"]}, {"type": "equation", "text": " $x$ "},
    ]
    got = files.layout_json_atoms(spark.createDataFrame([(1, json.dumps(items))], "document_id long, json string")).orderBy("atom_index").collect()
    assert [r.text for r in got] == ["## T", "c\n<table/>\nf", "cap", "```\nx=1\n```", "a\nb", "$x$"]
    assert got[1].page == 2 and got[1].is_table and got[0].bbox == []


def test_sinks(spark, tmp_path):
    schema = "chunk_id long, document_id long, content string, token_num int, dataset_id int"
    old = spark.createDataFrame([(1, 1, "a", 1, 1), (2, 2, "b", 1, 1), (3, 3, "c", 1, 2)], schema)
    path = str(tmp_path / "chunks")
    sinks.replace_document_chunks(spark, path, old, old)
    new = spark.createDataFrame([(4, 2, "bb", 1, 1)], schema)
    for _ in range(2):
        sinks.replace_document_chunks(spark, path, new, new)
    assert sorted((r.chunk_id, r.content) for r in sinks.read_chunks(spark, path).collect()) == [(1, "a"), (3, "c"), (4, "bb")]
    sinks.replace_document_chunks(spark, path, new.limit(0), old)
    assert sinks.read_chunks(spark, path).collect() == []
    v = spark.createDataFrame([(7, 1, [1.0, 2.0]), (7, 2, []), (8, 3, None)], "document_id long, chunk_id long, embedding array<float>")
    assert sinks.write_vectors(v, str(tmp_path / "v")).count() == 2 and sinks.read_vectors(spark, str(tmp_path / "v")).first().dim == 2
    sinks.write_vectors(v.limit(1).withColumn("embedding", F.array(F.lit(5.0).cast("float"))), str(tmp_path / "v"), v)
    assert [(r.chunk_id, r.embedding, r.dim) for r in sinks.read_vectors(spark, str(tmp_path / "v")).collect()] == [(1, [5.0], 1)]
    edits = spark.createDataFrame([(1, " new text ", 1), (2, " ", 1)], "chunk_id long, content string, edit_no int")
    every, changed = sinks.apply_chunk_edits(old, edits)
    assert {r.chunk_id: r.content for r in every.collect()}[1] == "new text" and [(r.chunk_id, r.token_num) for r in changed.collect()] == [(1, 5)]
    sinks.write_report(old, old, new, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "failures")).count() == 1


def test_markdown_rows(spark):
    rows = spark.range(300).select(F.col("id"), F.when(F.col("id") == 0, "a|b\nc").otherwise("x").alias("v"))
    got = files.rows_to_markdown(rows, "t", "id").orderBy("block_no").collect()
    assert len(got) == 2 and got[0].content.startswith("## t (0-255)\n\n| id | v |\n| --- | --- |\n| 0 | a\\|b<br>c |\n")


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, [-1.0, 0.0]), (6, None)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, [2.0])], "query_id long, embedding array<float>")
    for block in (1, 4096):
        got = sorted((r.query_id, r.rank, r.chunk_id) for r in retrieval.vector_topk(v, q, block=block).collect())
        assert got == [(7, 1, 1), (7, 2, 3), (9, 1, 4)]


def test_pruned_vectors(spark):
    import numpy as np

    from ragspark.operators import cells

    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.1).tolist()) for i in range(3000)]
    rows += [(5000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(900)] + [(9000, [0.0] * 6), (9001, None), (9002, []), (9003, [1.0, 2.0]), (9004, [-1.0, 2.0])]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(6)
    q = v.where("chunk_id % 97 = 0 OR chunk_id > 8999").select(F.col("chunk_id").alias("query_id"), "embedding")
    q = q.unionByName(spark.createDataFrame([(99999, [1.0, 2.0, 3.0])], "query_id long, embedding array<double>"))
    made = cells.vector_cells(v, 8, block=64)
    for k, least in ((10, 0.2), (3, None), (1, 0.99)):
        want = sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in retrieval.vector_topk(v, q, k, least).collect())
        got = sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in cells.pruned_topk(made, q, k, least, block=16).collect())
        assert got == want
    met = cells.pruning(made, q).first()
    assert 0 < met.met < 0.5 * met.pairs


def test_queries_in_turns(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SENT", 100)
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "chunk_id long, embedding array<double>")
    q = v.where("chunk_id < 30").withColumnRenamed("chunk_id", "query_id")
    got = sorted(map(tuple, retrieval.vector_topk(v, q, block=4).collect()))
    monkeypatch.undo()
    assert len(got) == 300 and got == sorted(map(tuple, retrieval.vector_topk(v, q).collect()))
