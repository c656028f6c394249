import random
import re

from pyspark.sql import functions as F

from docmill.operators import batches, headings, links, markdown, proof, sheets


def paras(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, para_no int, para string")


def test_typos_equal_regex_scan(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab😀 ") for _ in range(rnd.randrange(40))) for _ in range(200)]
    got = {(r.doc_id, r.start_pos, r.error_text) for r in proof.find_typos(paras(spark, texts), {"x": ["ab", "aa"], "y": ["😀"]}).collect()}
    want = {(i, m.start(), w) for i, t in enumerate(texts) for w in ("ab", "aa", "😀") for m in re.finditer(re.escape(w), t)}
    assert got == want


def unpaired(text, a, b):
    stack, out = [], []
    for i, c in enumerate(text):
        if c == a:
            stack.append(i)
        elif c == b:
            if stack:
                stack.pop()
            else:
                out.append(i)
    return {(i, text[i]) for i in out + stack}


def test_unpaired_equals_stack(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("()[]\"a") for _ in range(rnd.randrange(30))) for _ in range(200)]
    pairs = [("(", ")"), ("[", "]"), ('"', '"')]
    got = {(r.doc_id, r.start_pos, r.error_text) for r in proof.find_unpaired_symbols(paras(spark, texts), pairs).collect()}
    assert got == {(i, *u) for i, t in enumerate(texts) for a, b in pairs for u in unpaired(t, a, b)}


def test_sensitive_exceptions(spark):
    got = proof.find_sensitive(paras(spark, ["a Bad badge bad", "xbad bad"]), {"bad": ["badge", "xbad", "other"]}).collect()
    assert sorted((r.doc_id, r.start_pos) for r in got) == [(0, 2), (0, 12), (1, 5)]


def test_paragraphs_skip_code_and_rules_can_be_off(spark):
    docs = spark.createDataFrame([(1, "a\n```\ncode\n```\n\n> q\nb"), (2, None)], "doc_id long, text string")
    got = [(r.para_no, r.para) for r in proof.split_paragraphs(docs, skip_quotes=True).orderBy("para_no").collect()]
    assert got == [(0, "a"), (6, "b")]
    rows = proof.proofread(paras(spark, ["( x"]), {"y": ["x"]}, {}, [("(", ")")], {}, {"pairing": False})
    assert [r.source for r in rows.collect()] == ["typo"]


def test_map_only_operators_do_not_shuffle(spark):
    p = paras(spark, ["(a", "b"])
    for df in (proof.find_typos(p, {"x": ["a"]}), proof.find_unpaired_symbols(p), proof.find_sensitive(p, {"a": []}), headings.normalize_numbering(p.select(F.col("para").alias("text")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


def test_heading_counters(spark):
    text = "# a\n## b\n## c\n# d\n## e\n### f\n```\n# no\n```\n#### 1.1 g"
    docs = spark.createDataFrame([(text,)], "text string")
    got = headings.add_numbering(docs, "hierarchical_standard").first().text
    assert got == "# 1 a\n## 1.1 b\n## 1.2 c\n# 2 d\n## 2.1 e\n### 2.1.1 f\n```\n# no\n```\n#### 2.1.1.1 1.1 g"
    assert headings.normalize_numbering(docs, {4: "{2.arabic_half}) "}).first().text.endswith("#### 1) g")


def test_sections_and_blocks(spark):
    text = "# A\nx\n## B b\ny\n### C\nz\n\n## D\npara one\npara two ^id1"
    row = spark.createDataFrame([(text,)], "t string").select(
        markdown.extract_section(F.col("t"), F.lit("bB")).alias("s"), markdown.extract_block(F.col("t"), F.lit("id1")).alias("b"), markdown.extract_section(F.col("t"), F.lit("none")).alias("n")
    ).first()
    assert row.s == "## B b\ny\n### C\nz" and row.b == "para one\npara two" and row.n is None


def test_tables_ignore_fences_and_short_runs(spark):
    text = "```\n| a | b |\n|---|---|\n| 1 | 2 |\n```\nx | H | I |\n|:-:|--:|\n| 3 | 4 \\| 5 | 6 |\n| 7 |\n\n| no |\n|---|"
    rows = markdown.extract_tables(spark.createDataFrame([(1, text)], "id long, text string")).collect()
    assert len(rows) == 1 and rows[0].headers == ["H", "I"] and rows[0].rows == [["3", "4 | 5"], ["7", ""]] and rows[0].alignments == ["center", "right"]


def test_link_targets(spark):
    cases = {"file.md#标题": ("file.md", "标题", None), "f%20n.md#^b": ("f n.md", None, "b"), "f.md?v=1": ("f.md", None, None), "f.md#": ("f.md", None, None), "a+b.md": ("a+b.md", None, None), "100%.md": ("100%.md", None, None)}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", links.parse_target(F.col("x")).alias("t")).collect()
    assert {r.x: tuple(r.t) for r in got} == cases


def test_embeds_cycle_depth_and_missing(spark):
    docs = spark.createDataFrame([("a.md", "A ![[b]] ![[none]]"), ("b.md", "B ![[a]] ![[c#H]]"), ("c.md", "top\n# H\nC ![[d]]"), ("d.md", "D ![[e]]"), ("e.md", "E")], "path string, text string")
    got = {r.path: r.text for r in links.expand_embeds(docs).collect()}
    assert got["a.md"] == "A B [cycle: a] # H\nC D [too deep: e] [not found: none]"
    assert got["d.md"] == "D E"


def test_cell_merge_and_order(spark):
    def merged(*values):
        df = spark.createDataFrame([(i, 1, 1, v) for i, v in enumerate(values)], "file_no int, row int, col int, value string")
        rows = sheets.merge_by_cell(df, []).collect()
        return rows[0].value if rows else None

    assert [merged("1", "2"), merged("A", "A"), merged("A", "B"), merged("", "x"), merged(None, None), merged("1", "x", "2"), merged("1", "2", "x"), merged("1.5", "2")] == ["3", "A", "A,B", "x", None, "1,x,2", "3,x", "3.5"]


def test_alignment_equals_brute_scan(spark):
    rnd = random.Random(5)
    base = {(r, c): rnd.choice("abcdef") for r in range(12) for c in range(6)}
    collect = {(r - 3, c + 2): v for (r, c), v in base.items() if rnd.random() < 0.6}
    make = lambda cells: spark.createDataFrame([(1, r, c, v) for (r, c), v in cells.items()], "g int, row int, col int, value string")
    got = sheets.align_tables(make(base), make(collect), ["g"]).first()
    best = min(((-sum(base.get((r + dr, c + dc)) == v for (r, c), v in collect.items()), dr, dc) for dr in range(-10, 11) for dc in range(-10, 11)))
    assert (got.n, got.dr, got.dc) == (-best[0], best[1], best[2])
    far = sheets.align_tables(make({(60, 60): "x", (61, 60): "y"}), make({(1, 1): "x", (2, 1): "y"}), ["g"]).first()
    assert (far.dr, far.dc, far.n) == (59, 59, 2)


def test_blocks(spark):
    rows = [("s", 0, 0, "X"), ("s", 1, 1, "Y"), ("t", 0, 0, " "), ("t", 0, 1, "A"), ("u", 0, 0, "a"), ("u", 0, 2, "b"), ("u", 1, 0, "c"), ("u", 1, 1, "d"), ("u", 1, 2, "e")]
    got = sheets.find_blocks(spark.createDataFrame(rows, "sheet string, row int, col int, value string"), ["sheet"]).collect()
    assert sorted(map(tuple, got)) == [("s", 0, 0, 0, 0), ("s", 1, 1, 1, 1), ("t", 0, 1, 0, 1), ("u", 0, 0, 1, 2)]


def test_page_ranges(spark):
    cases = {"1-3，5;7~10": [1, 2, 3, 5, 7, 8, 9, 10], "3-1": [1, 2, 3], "2,2": [2], "x": None, "": None, "0": None}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", batches.parse_page_ranges(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in got} == cases


def test_front_matter_that_is_none(spark):
    from docmill.operators import markdown

    sources = ["a: 2024-13-45", "a: &x [*x]", "a: 1", "a: [b, [c, null, true]]", "- a", "? [a]\n: b", None, "a: " + "[" * 80 + "]" * 80]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, s string")
    got = {r.i: r.m for r in rows.select("i", markdown.parse_front_matter("s").alias("m")).collect()}
    assert got == {0: {}, 1: {}, 2: {"a": ["1"]}, 3: {"a": ["b", "c", "true"]}, 4: {}, 5: got[5], 6: {}, 7: {}}


def test_csv_with_long_cells_and_without_content(spark):
    from docmill.sources import files

    rows = spark.createDataFrame([(1, bytearray(b"a," + b"x" * 200_000)), (2, None), (3, bytearray(b""))], "k int, content binary")
    assert [(r.k, r.row, r.col, len(r.value)) for r in files.read_csv_cells(rows, ["k"]).orderBy("col").collect()] == [(1, 1, 1, 1), (1, 1, 2, 200_000)]


def test_batch_stops_after_the_first_failure(spark):
    from docmill.operators import batches

    rows = spark.createDataFrame([("a", 1, "success"), ("a", 2, "failed"), ("a", 3, "success"), ("a", 4, "failed"), ("b", 1, "skipped"), (None, 5, "failed"), (None, 6, "success")], "job string, file_no int, status string")
    got = {r.job: (r.total, r.processed, r.success, r.failed, r.skipped) for r in batches.batch_summary(rows, ["job"], continue_on_error=False).collect()}
    assert got == {"a": (4, 2, 1, 1, 0), "b": (1, 1, 0, 0, 1), None: (2, 1, 0, 1, 0)}


def test_item_lines_of_an_odd_page(spark):
    """Without stars a complete line ends a row; a page of few labels, and one without spans, has none; no Python runs."""
    from docmill.operators import invoices

    head = [(10.0, 1.0, "项目名称"), (50.0, 1.0, "数 量"), (90.0, 1.0, "金额"), (120.0, 1.0, "税额")]
    body = [(10.0, 11.0, "first"), (50.0, 11.5, "2"), (120.0, 12.0, "0.1"), (10.0, 21.0, "second"), (12.0, 31.0, "part"), (91.0, 31.0, "5"), (121.0, 31.0, "0.2"), (130.0, 31.0, "y"), (10.0, 60.0, "合计")]
    spans = [(1, *s) for s in head + body] + [(2, *s) for s in head[:3] + body] + [(3, 10.0, 1.0, None)]
    found = invoices.invoice_lines_from_spans(spark.createDataFrame(spans, "page int, x0 double, y0 double, text string"), ["page"])
    got = [(r.page, r.line_no, r["商品名称"], r["数量"], r["金额"], r["税额"]) for r in found.orderBy("page", "line_no").collect()]
    assert got == [(1, 0, "first", "2", "", "0.1"), (1, 1, "secondpart", "", "5", "0.2 y")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_item_lines_of_a_text(spark):
    from docmill.operators import invoices

    head = "发票号码：1\n项目名称 规格型号 单 位 数 量 单 价 金 额 税率/征收率 税 额\n"
    texts = [
        head + "*纸品*信笺 2.5kg 3×2包 包 4 12.5 50.00 13% 6.50\n*文具*钢笔 蓝色 加长 5×2支 支 10 8.25 82.50 6% 4.95\n*图书*词典 1×1册 册 2 63.75 127.50 免税 ***\n*运输*搬运费 3 20 60.00 9% 5.40\n合     计 ¥320.00 ¥16.85\n价税合计 （小写）¥336.85\n",
        head + "plain\nname\n3\n免\n税\n*\nother\n1\n3\n%\n0.5\n合计\n",
        "no labels\n*a*b 1 13% 2",
        None,
    ]
    found = invoices.invoice_lines_from_text(spark.createDataFrame(list(enumerate(texts)), "page int, text string"), ["page"])
    rows = found.orderBy("page", "line_no").collect()
    first = [r for r in rows if r.page == 0]
    assert [r["商品名称"] for r in first][1:] == ["*文具*钢笔 蓝色 加长", "*图书*词典", "*运输*搬运费"]
    assert first[0]["商品名称"].startswith("*纸品*信笺") and (first[0]["单位"], first[0]["数量"], first[0]["单价"]) == ("包", "4", "12.5")
    assert [(r["规格型号"], r["单位"], r["数量"], r["单价"], r["税率"], r["税额"]) for r in first][1:] == [("5×2支", "支", "10", "8.25", "6%", "4.95"), ("1×1册", "册", "2", "63.75", "免税", "***"), ("", "", "3", "20", "9%", "5.40")]
    assert sum(round(float(r["金额"]) * 100) for r in first) == 32000
    assert [(r.page, r["商品名称"], r["金额"], r["税率"], r["税额"]) for r in rows[4:]] == [(1, "plainname", "3", "免税", "*"), (1, "other", "", "13%", "0.5")]


def test_file_formats_by_bytes(spark):
    from docmill.sources.files import SAMPLE, detect_file_format

    cases = [
        (b"", "txt"), (b"\x00" * 20 + b"a" * 100, None), (b"\x00" * 10 + b"a" * 90, "txt"), ("é".encode() * SAMPLE, "txt"), (b"a" + "é".encode() * SAMPLE, "txt"), ("中文".encode("gbk") * SAMPLE, "txt"), (b"a" + "中".encode("gbk") * SAMPLE, "txt"),
        (b"\xff\xfe\xff", None), (b"\x01\x02ab", None), (b"a,b,c\r\n1,2,3\r\n", "csv"), ("| a | b |\n|---|---|\n".encode(), "md"), (b"%PDF-1.4", "pdf"), (None, None), (b"\t\n \r\n", "txt"),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = rows.select("i", detect_file_format(F.col("content"), F.lit("txt")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [want for _, want in cases]


def test_corpus_of_files(spark, tmp_path):
    from docmill.sources.files import IGNORED, read_corpus

    for name in ("a.md", "sub/B.CSV", "c.exe", f"{IGNORED[0]}/d.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in read_corpus(spark, str(tmp_path)).select("path").collect()) == ["B.CSV", "a.md"]
