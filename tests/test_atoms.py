"""Chunks from atoms: sections over mixed kinds, runs of plain text, resumes with identity, question-answer pairs of headings and tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ragspark.operators import atoms as A
from ragspark.operators import chunking, structure

ATOMS = "document_id long, atom_index int, text string, element_type string, page int, bbox array<double>, parser_name string, is_table boolean, heading_level int, image_key string, need_vision boolean, description string"


def atom(index, text, kind="", page=0, bbox=(), parser="", table=False, level=0, key=None, scan=False, seen=None, doc=1):
    return (doc, index, text, kind, page, list(bbox), parser, table, level, key, scan, seen)


def frame(spark, rows):
    return spark.createDataFrame(rows, ATOMS)


def docs(spark, name="a.pdf", n=1):
    return spark.createDataFrame([(i, 7, name, "") for i in range(1, n + 1)], "document_id long, dataset_id int, name string, text string")


def chunks(spark, rows, template="general", name="a.pdf", **more):
    return chunking.build_chunks_atoms(docs(spark, name), frame(spark, rows), template, **more).orderBy("chunk_index").collect()


def test_runs_of_plain_text_are_joined(spark):
    rows = [atom(0, "one"), atom(1, "two"), atom(2, "| a | b |\n|---|---|\n| 1 | 2 |", "table", table=True), atom(3, ""), atom(4, "three"), atom(5, "![x](y.png)", "image"), atom(6, "four"), atom(7, "placed", "text", 3, [1.0, 2.0], "vlm"), atom(8, "five"), atom(9, "six")]
    got = chunks(spark, rows)
    assert [(r.content, r.element_type, r.page_number, r.bbox, r.parser_name) for r in got] == [
        ("one\n\ntwo", "text", 0, [], ""), ("| a | b |\n|---|---|\n| 1 | 2 |", "table", 0, [], ""), ("three", "text", 0, [], ""), ("![x](y.png)", "image", 0, [], ""),
        ("four", "text", 0, [], ""), ("placed", "text", 3, [1.0, 2.0], "vlm"), ("five\n\nsix", "text", 0, [], ""),
    ]
    assert [r.chunk_index for r in got] == list(range(7)) and len({r.chunk_id for r in got}) == 7


def test_runs_like_a_fold(spark):
    """Against one atom after another."""
    rnd = random.Random(3)
    rows, want = [], []
    for doc in range(1, 40):
        run, out = [], []
        for i in range(rnd.randint(0, 12)):
            kind, text = rnd.choice(["plain", "plain", "plain", "table", "figure", "placed", "image"]), rnd.choice(["", "x", "yy\nz", " "])
            rows.append(atom(i, text, {"table": "table", "figure": "image"}.get(kind, ""), parser="p" if kind == "placed" else "", table=kind == "table", key="k" if kind == "image" else None, seen="d" if kind == "image" else None, doc=doc))
            if kind == "plain":
                run.append(text)
                continue
            out += ["\n\n".join(run).strip()]
            run = []
            out += ["[图片] " + "\n".join(x for x in (text.strip(), "d") if x)] if kind == "image" else [text.strip()]
        out += ["\n\n".join(run).strip()]
        want += [(doc, x) for x in out if x]
    got = chunking.build_chunks_atoms(docs(spark, n=40), frame(spark, rows)).orderBy("document_id", "chunk_index").collect()
    lone = {r.document_id for r in A.failed_documents(frame(spark, rows)).collect()}
    assert not lone and [(r.document_id, r.content) for r in got] == want


def test_images(spark):
    rows = [atom(0, "cap", "image", 2, parser="vlm", key="a.png", seen="a map"), atom(1, "", "image", key="b.png", seen=""), atom(2, "$x$", "formula", parser="vlm", key="f.png", seen="no"), atom(3, "same", "chart", parser="vlm", key="c.png", seen="same"), atom(4, "", key="gone.png"), atom(5, "tail")]
    got = chunks(spark, rows)
    assert [(r.content, r.image_key) for r in got] == [("[图片] cap\na map", "a.png"), ("[图片] （无文字描述）", "b.png"), ("$x$", "f.png"), ("[图片] same", "c.png"), ("tail", "")]
    scan = [atom(0, "text"), atom(1, "", key="s.png", scan=True), atom(0, "", key="i.png", doc=2), atom(0, "", key="j.png", seen="seen", doc=3)]
    assert {r.document_id: r.reason for r in A.failed_documents(frame(spark, scan)).collect()} == {1: "a scan needs a vision model", 2: "an image needs a vision model"}
    assert {r.document_id for r in chunking.build_chunks_atoms(docs(spark, n=3), frame(spark, scan)).collect()} == {3}


def test_sections_keep_tables_and_places(spark):
    rows = [
        atom(0, "第一章 起点\n开篇\n\n\n正文"), atom(1, "more"), atom(2, "| a | b |\n|---|---|\n| 1 | 2 |", "table", 4, table=True), atom(3, "after the table"), atom(4, "", "image", key="k.png", seen="map"),
        atom(5, "第一节 背景", "title", 5, parser="vlm"), atom(6, "placed one", "text", 6, [1.0], "vlm"), atom(7, "placed two", "text", 7, [2.0], "vlm"), atom(8, "plain\n第二章 完\n�第二节 尾�\nend"), atom(9, "x = 1", "code", 8),
    ]
    got = A.section_atoms(frame(spark, rows), "book").orderBy("atom_index").collect()
    assert [(r.section_path, r.text, r.element_type, r.page) for r in got] == [
        ("第一章 起点", "开篇\n\n正文\nmore", "text", 0), ("第一章 起点", "| a | b |\n|---|---|\n| 1 | 2 |", "table", 4), ("第一章 起点", "after the table", "text", 0), ("第一章 起点", "", "image", 0),
        ("第一节 背景", "placed one", "text", 6), ("第一节 背景", "placed two", "text", 7), ("第一节 背景", "plain", "text", 0), ("第二章 完 / 第二节 尾", "end", "text", 0), ("第二章 完 / 第二节 尾", "x = 1", "code", 8),
    ]
    made = chunks(spark, rows, "book")
    assert made[1].content == "第一章 起点\n\n| a | b |\n|---|---|\n| 1 | 2 |" and made[1].element_type == "table" and made[1].page_number == 4
    assert made[3].content == "第一章 起点\n\n[图片] map" and made[3].image_key == "k.png" and made[4].bbox == [1.0]
    long = "Abstract\n" + "words of it. " * 80
    assert len(chunks(spark, [atom(0, long)], "paper")) == 1 and len(chunks(spark, [atom(0, long.replace("Abstract", "1 Intro"))], "paper")) == 3


@pytest.mark.parametrize("template", ["book", "paper"])
def test_sections_like_a_fold(spark, template):
    rnd = random.Random(9)
    lines = ["# A", "## B", "### C", "第一章 x", "1.2 Part", "Abstract", "", " ", "text", "more text", "�"]
    rows, want = [], []
    for doc in range(1, 60):
        heads, body, out = {}, [], []

        def flush():
            text = "\n".join(body).strip()
            body.clear()
            if text:
                out.append((" / ".join(heads[k] for k in sorted(heads)), text))

        for i in range(rnd.randint(0, 7)):
            kind, parser = rnd.choice(["text", "text", "list", "table", "code"]), rnd.choice(["", "", "p"])
            text = "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 6)))
            rows.append(atom(i, text, kind, parser=parser, table=kind == "table", doc=doc))
            if kind in ("table", "code"):
                flush()
                out.append((" / ".join(heads[k] for k in sorted(heads)), text))
                continue
            for line in text.split("\n"):
                line = line.strip()
                level = len(m[1]) if (m := re.match("(#+) ", line)) else (1 if line.startswith("第") and template == "book" else 2 if line == "1.2 Part" and template == "paper" else 1 if line == "Abstract" and template == "paper" else 0)
                if not line:
                    if body and body[-1]:
                        body.append("")
                elif level:
                    flush()
                    heads = {k: v for k, v in heads.items() if k < level} | {level: line.lstrip("# ")}
                else:
                    body.append(line)
            if parser:
                flush()
        flush()
        want += [(doc, *x) for x in out]
    got = A.section_atoms(frame(spark, rows), template).orderBy("document_id", "atom_index").collect()
    assert [(r.document_id, r.section_path, r.text) for r in got] == want


RESUME = [
    "张三\n求职意向：Golang 后端开发\n电话：13800000000\n邮箱：zhangsan@example.com", None, "教育背景", "示例大学\n软件工程 本科", "专业技能", "Go、PostgreSQL、Redis", "项目经历",
    "1. 二手交易平台", "技术栈：Go、Vue\n- 使用 Redis 缓存", "2. 考试系统", "技术栈：Go、Svelte\n- 使用异步任务队列",
]


def test_resume_chunks_carry_who_it_is(spark):
    rows = [atom(i, t or "", "text" if t else "image", parser="vlm", key=None if t else "avatar.png", seen=None if t else "a face") for i, t in enumerate(RESUME)]
    got = chunks(spark, rows, "resume", "张三简历.pdf")
    who = "\n\n[候选人摘要] 姓名:张三 | 电话:13800000000 | 邮箱:zhangsan@example.com | 求职意向:Golang 后端开发"
    assert [r.content.split("\n\n")[0] for r in got] == ["基本信息", "教育背景", "专业技能", "项目经历 1. 二手交易平台", "项目经历 2. 考试系统"]
    assert all(r.content.endswith(who) and r.parser_name == "resume-structured/vlm" and r.page_number == 1 for r in got)
    assert "Redis 缓存" in got[3].content and "考试系统" not in got[3].content
    one = chunks(spark, [atom(0, "skills\nGo\nprojects\n" + "9. " + "x" * 40 + "\nbody")], "resume")
    assert [r.content for r in one] == ["专业技能\n\nGo", "项目经历\n\n9. " + "x" * 40 + "\nbody"] and one[0].parser_name == "resume-structured"


def test_long_resume_entries_are_split_with_title_and_summary(spark):
    text = "Ann Lee\na@b.com\nprojects\n1. First\n" + "".join(f"line {i} of work, done. \n" for i in range(120)) + "2. " + "y" * 50 + "\nshort"
    got = chunks(spark, [atom(0, text)], "resume", target=200, overlap=20)
    tail = "\n\n[候选人摘要] 姓名:Ann Lee | 邮箱:a@b.com"
    assert len(got) > 10 and all(r.content.endswith(tail) for r in got)
    assert all(len(r.content) <= 200 + 20 + len("项目经历 1. First\n\n") + len(tail) for r in got)
    assert got[-1].content.startswith("项目经历 2\n\n2. yyy") and got[1].content.startswith("项目经历 1. First\n\n1. First")


def test_resume_entries_like_a_fold(spark):
    rnd = random.Random(6)
    lines = ["1. a", "2010-2012 x", "b", "二、c", "2013.1 to present y", "d", "3) 2001-2002"]
    for number, dates in ((structure._NUMBERED, structure._DATES),):
        number, dates = re.compile(number), re.compile(dates)
        rows, want = [], []
        for doc in range(80):
            text = [rnd.choice(lines) for _ in range(rnd.randint(1, 12))]
            rows.append((doc, "projects\n" + "\n".join(text)))
            text = [x for i, x in enumerate(text) if not i or text[i - 1] != x]
            entries = []
            for x in text:
                if not entries or number.match(x) or (dates.search(x) and dates.search(entries[-1][0])):
                    entries.append([])
                entries[-1].append(x)
            want += [(doc, n, "\n".join(e)) for n, e in enumerate(entries)]
        got = structure.resume_sections(structure.lines_of(spark.createDataFrame(rows, "document_id long, text string"))).orderBy("document_id", "entry_no").collect()
        assert [(r.document_id, r.entry_no, r.text) for r in got] == want


def test_sections_of_a_resume_begin_where_their_heading_does(spark):
    d = spark.createDataFrame([(1, "skills\nprojects\np\nskills\ns\nname")], "document_id long, text string")
    assert [r.section for r in structure.resume_sections(structure.lines_of(d)).orderBy("entry_no").collect()] == ["专业技能", "项目经历"]


def qa(spark, name, rows):
    return [(r.question, r.answer, r.parser_name, r.page) for r in A.qa_pairs(docs(spark, name), frame(spark, rows)).orderBy("pair_no").collect()]


def test_pairs_of_headings_and_tables_in_reading_order(spark):
    table = "| 问 | 答 |\n| --- | - - |\n| q1 | | a1 | x |\n| only | |"
    rows = [atom(0, "lost\n# 账户\n说明"), atom(1, table, "table", table=True), atom(2, "after"), atom(3, "如何?", "title", level=2), atom(4, "点这里\n```\n# no\n```"), atom(5, "", key="p.png")]
    assert qa(spark, "f.docx", rows) == [("账户", "说明", "qa-heading", 0), ("问", "答", "qa-table", 0), ("q1", "a1", "qa-table", 0), ("账户", "after", "qa-heading", 0), ("账户\n如何?", "点这里\n```\n# no\n```", "qa-heading", 0)]
    assert qa(spark, "f.md", rows) == [("账户", f"说明\n{table}\nafter", "qa-heading", 0), ("账户\n如何?", "点这里\n```\n# no\n```", "qa-heading", 0)]
    bullets = [atom(0, "1. 如何退款\n提交退款申请。\n2. 多久到账", page=3, parser="vlm"), atom(1, table, "table", table=True), atom(2, "通常三个工作日。", page=4)]
    assert qa(spark, "f.pdf", bullets) == [("如何退款", "提交退款申请。", "qa-bullets", 3), ("多久到账", "通常三个工作日。", "qa-bullets", 3)]
    md = "# 账户\n账户相关说明\n## 如何重置密码？\n进入设置页面重置。\n## 如何修改邮箱？\n联系管理员。"
    d = spark.createDataFrame([(1, 2, "faq.md", md)], "document_id long, dataset_id int, name string, text string")
    got = chunking.build_chunks(d, "qa").orderBy("chunk_index").collect()
    assert len(got) == 3 and got[1].content == "问题：账户\n如何重置密码？\n\n回答：进入设置页面重置。" and got[1].embed_text == "faq.md\n账户\n如何重置密码？"


def test_text_files(spark):
    d = spark.createDataFrame([(1, "a.txt", "![x](data:image/png;base64,QUJD)\n| a | b |\n|---|---|"), (2, "b.MD", "t ![ map ](data:image/jpeg;base64,QUJD) ![u](http://x/y.png) ![bad](data:image/png;base64,?)\n| a | b |\n|---|---|"), (3, "c.md", "")], "document_id long, name string, text string")
    got = A.document_atoms(d).orderBy("document_id", "atom_index").collect()
    assert [(r.document_id, r.text, r.element_type, r.image_key, r.is_table) for r in got][1:] == [
        (2, "t", "text", None, False), (2, "map", "image", "2/images/1.jpg", False), (2, "![u](http://x/y.png)", "image", None, False), (2, "![bad](data:image/png;base64,?)", "image", None, False), (2, "| a | b |\n|---|---|", "table", None, True),
    ]
    assert got[0].text.startswith("![x]") and got[0].element_type == "text"


def test_table_rules():
    parts = chunking.markdown_parts
    assert [k for k, _ in parts("see <TABLE><tr></tr></table> end\nmore")] == ["table", "text"]
    assert parts("a|b\n- -|: - :\nc|d\n\nx")[0] == ("table", "a|b\n- -|: - :\nc|d")
    assert parts("-|-\n-|-\nc|d") == [("table", "-|-\n-|-\nc|d")]
    assert [k for k, _ in parts("~~~\n<table>\n```\n~~~~\n<table>\nx")] == ["text", "table"]
    assert chunking.table_parts("| a | b |\n| - - | - |\n" + "| 1 | 2 |\n" * 9, 40)[1].startswith("| a | b |\n| - - | - |\n")


def test_pipe_tables(spark):
    text = "x\na|b\n- -|-\n1|2\n-|-\n3|4\nno row\nnot|a table\n\n-|-\n:-|-:\n5|6"
    d = spark.createDataFrame([(1, text)], "document_id long, text string")
    got = structure.pipe_tables(structure.lines_of(d)).orderBy("line_no").collect()
    assert [(r.table_no, r.cells, r.is_header) for r in got] == [(1, ["a", "b"], True), (1, ["1", "2"], False), (1, ["3", "4"], False), (2, ["-", "-"], True), (2, ["5", "6"], False)]


def test_hyphens_of_many_lines(spark):
    rnd = random.Random(2)
    rows = [([rnd.choice(["one-", "two", "A-", "--", "x -", "ß-", "", "Up", "to-", "1-"]) for _ in range(rnd.randint(0, 9))],) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame(rows, "l array<string>").select(structure.dehyphenate(F.col("l"))).collect()]
    for (given,), have in zip(rows, got, strict=True):
        want = []
        for line in given:
            if want and len(want[-1]) > 1 and want[-1][-1] == "-" and want[-1][-2].isalpha() and line[:1].isalpha():
                goes = want[-1][-2].islower() and re.match(r"[a-zß]+(\s|$)", line)
                want[-1] = (want[-1][:-1] if goes else want[-1]) + line
            else:
                want.append(line)
        assert have == want
