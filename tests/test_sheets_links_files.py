"""Merging of sheets by line and column, cycles of links, formats of containers, invoices without labels: against plain Python and small cases."""

import random

from pyspark.sql import functions as F

from docmill.operators import headings, invoices, links, markdown, sheets
from docmill.sources import files


def plain_merge(base, collect):
    """Line after line, cell after cell."""
    width = max(map(len, base + collect), default=0)
    grid = [line + [""] * (width - len(line)) for line in base]

    def value(x):
        try:
            return float(x)
        except ValueError:
            return x.strip()

    for line in (x + [""] * (width - len(x)) for x in collect):
        if not any(x.strip() for x in line):
            continue
        for i, own in enumerate(grid):
            a, b = [value(x) for x in own], [value(x) for x in line]
            both = [x == y for x, y in zip(a, b, strict=True) if x != "" and y != ""]
            less, more = any(x != "" and y == "" for x, y in zip(a, b, strict=True)), any(x == "" and y != "" for x, y in zip(a, b, strict=True))
            if any(x != "" for x in a) and all(both) and not (less and more):
                if more:
                    grid[i] = line
                break
        else:
            scores = [sum(x.strip() == y.strip() for x, y in zip(own, line, strict=True)) for own in grid]
            grid.insert(scores.index(max(scores)) + 1 if grid else 0, line)
    return grid


def test_grid_merge_equals_plain(spark):
    rng = random.Random(4)
    cell = lambda: rng.choice(["", "", " ", "1", "1.0", " a", "a", "b"])
    made = [[[[cell() for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(5))] for _ in range(2)] for _ in range(150)]
    for base, collect in made:
        assert sheets._grid_merge(base, collect) == plain_merge(base, collect)
    cells = lambda side: spark.createDataFrame([(k, r + 1, c + 1, v) for k, m in enumerate(made) for c, column in enumerate(m[side]) for r, v in enumerate(column)], "k int, row int, col int, value string")
    found = {(r["k"], r["row"], r["col"]): r["value"] for r in sheets.merge_by_column(cells(0), cells(1), ["k"]).collect()}
    want = {}
    for k, (base, collect) in enumerate(made):
        grid = plain_merge(base, collect)
        want |= {(k, r, c): v for c, column in enumerate(grid, 1) for r, v in enumerate(column, 1) if v.strip()}
    assert found == want


def test_cycles_equal_search(spark):
    rng = random.Random(6)
    edges = {(str(rng.randrange(25)), str(rng.randrange(25))) for _ in range(45)} | {("self", "self")}
    df = spark.createDataFrame([*edges, ("0", None)], "source string, target string")
    want = {}
    for node in {a for a, _ in edges}:
        ends = {node}
        for length in range(1, 5):
            ends = {b for a, b in edges if a in ends}
            if node in ends:
                want[node] = length
                break
    assert {r["node"]: r["length"] for r in links.link_cycles(df, 4).collect()} == want
    assert links.link_cycles(df.limit(0)).count() == 0


def test_containers(spark):
    zipped, compound = files.packed_file, files.compound_file
    cases = [
        (zipped({"mimetype": files.ODF + "spreadsheet"}), "zip", "ods"), (zipped({"mimetype": "other", "word/a": "b"}), "zip", "docx"), (zipped({"Doc_0/x": ""}), "zip", "ofd"), (zipped({"FixedDocumentSequence.fdseq": ""}), "x", "xps"),
        (zipped({"x": ""}), "XLSX", "xlsx"), (b"PK\x03\x04 broken", "odt", "odt"), (b"PK\x03\x04", None, "docx"), (compound(("1Table",)), "x", "doc"), (compound(("Book",)), "doc", "xls"), (compound(()), "et", "et"), (compound(())[:60], "doc", "doc"),
        (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "xlsx", "xls"), (b"# a\n", "bin", "md"), (b"\xff\xfe\x00", "JPG", "jpeg"), (b"\xff\xfe\x00", None, "unknown"), (None, "pdf", "pdf"), (b"", "txt", "txt"),
    ]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None, e) for i, (c, e, _) in enumerate(cases)], "i int, content binary, ext string")
    got = [r["f"] for r in df.select("i", files.detect_format(F.col("content"), F.col("ext")).alias("f")).orderBy("i").collect()]
    assert got == [want for *_, want in cases]


def test_invoice_without_labels(spark):
    texts = ["", None, "12345678", "2021030412345678、1234567890", "开票日期：2021年3月4日 20210304、87654321、" + "1" * 20, "发票号码：99999999、12345678"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = invoices.invoice_header(df, by_digits=True).orderBy("k").collect()
    got = [tuple(r[c] for c in ("开票日期", "发票号码", "发票代码", "校验码")) for r in rows]
    assert got == [("", "", "", ""), ("", "", "", ""), ("", "12345678", "", ""), ("2021年03月04日", "12345678", "1234567890", ""), ("2021年03月04日", "87654321", "", "1" * 20), ("", "99999999", "", "")]
    assert invoices.invoice_header(df).filter("`发票号码` <> ''").count() == 1


def test_blocks_and_numbers_of_odd_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "# a?\nb\nc"), (4, "# a:"), (5, "a\n---\n\n---\n# b.\n- x")], "k int, text string")
    found = {(r["k"], r["seq"]): (r["type"], r["content"]) for r in markdown.merge_heading_content(markdown.segment_blocks(df), ["k"]).collect()}
    assert found == {(3, 0): ("heading_with_content", " b"), (3, 2): ("paragraph", None), (4, 0): ("heading", None), (5, 0): ("heading", None), (5, 1): ("hr", None), (5, 2): ("heading", None), (5, 3): ("bullet", None)}
    paras = spark.createDataFrame([(1, 0, None), (1, 1, "一、x"), (1, 2, "（一）y。z"), (2, 0, "plain")], "k int, para_no int, text string")
    rows = headings.headings_from_paragraphs(paras, ["k"], "gongwen_standard").orderBy("k", "para_no").collect()
    assert [r["heading"] for r in rows] == [None, "# 一、x", "## （一）y", None]


def test_code_within_lists_and_formulas(spark):
    text = "- a\n  - b $x$\n    ```\n    c\n    ```\n   ~~~\n   d\n   ~~~\n```\ne\n```\n  - f\n\nplain \\$5 and $6\n    ```\n    g\n    ```\n# $h$\n> $$i$$"
    rows = markdown.segment_blocks(spark.createDataFrame([(1, text)], "k int, text string")).orderBy("seq").collect()
    assert [(r.type, r.level, r.list_level, r.in_list_context, r.has_formula) for r in rows] == [
        ("bullet", 1, None, False, False), ("bullet", 2, None, False, True), ("code", None, 2, True, False), ("code", None, 2, True, False), ("code", None, None, False, False),
        ("bullet", 2, None, False, False), ("paragraph", None, None, False, False), ("code", None, None, False, False), ("heading", 1, None, False, False), ("quote", 1, None, False, True),
    ]


def test_embeds_of_files_and_in_tables(spark):
    docs = [
        ("a/x.md", "![[y#^b]] ![t](../q.md) ![[z.pdf]] ![p](data:image/png;base64,AA) ![[n\nm]] ![[]]\n|---|\n> | ![[y#^b]] | ![[none]] |"),
        ("a/y.md", "one | two\nthree \\| four ^b"), ("a/z.md", None), ("a/e.md", "![[z]]![[y#^none]]"),
    ]
    df = spark.createDataFrame(docs, "path string, text string")
    got = {r["path"]: r["text"] for r in links.expand_embeds(df, assets=spark.createDataFrame([("a/z.pdf",)], "path string")).collect()}
    block = "one | two\nthree \\| four"
    flat = "one \\| two<br>three \\| four"
    assert got["a/x.md"] == f"{block} [not found: ../q.md] ![[z.pdf]] ![p](data:image/png;base64,AA) ![[n\nm]] ![[]]\n|---|\n> | {flat} | [not found: none] |"
    assert got["a/z.md"] is None and got["a/e.md"] == "[not found: z][no such section: y#^none]"
    assert links.expand_embeds(df.limit(0)).count() == 0
