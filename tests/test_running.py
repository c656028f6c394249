"""Running values over a document's lines and signs, against plain Python; long documents in time that grows with them."""

import random
import re
import time

from pyspark.sql import functions as F

from docmill.operators import headings, links, markdown, proof
from docmill.operators.lines import doc_lines, owned, scan


def test_scan_and_owned(spark):
    rng = random.Random(7)
    rows = [(n, [rng.randrange(9) for _ in range(n)], [rng.random() < 0.6 for _ in range(n)]) for n in (0, 1, 2, 255, 256, 257, 512, 700)]
    df = spark.createDataFrame(rows, "n int, xs array<int>, on array<boolean>")
    found = df.select("n", scan(F.col("xs"), F.lit(0), lambda a, x: a * 3 % 101 + x, "int").alias("s"), F.when(F.size("on") > 0, owned(F.col("on"))).alias("o")).collect()
    plain = {n: (xs, on) for n, xs, on in rows}
    for r in found:
        xs, on = plain[r["n"]]
        state, states = 0, []
        for x in xs:
            state = state * 3 % 101 + x
            states.append(state)
        assert r["s"] == states
        heads = [i for i in range(len(on)) if not on[i] or i == 0]
        if on:
            assert [tuple(o) for o in r["o"]] == list(zip(heads, heads[1:] + [len(on)], strict=True))


def test_fenced_lines(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["```", "a", "", "```x", " ```", "b```"]) for _ in range(rng.randrange(12))) for _ in range(200)] + ["```", "", "\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = set()
    for k, text in enumerate(texts):
        fences = 0
        for i, line in enumerate((text or "").split("\n")):
            is_fence = line.startswith("```")
            fences += is_fence
            want.add((k, i, line, is_fence or fences % 2 == 1))
    assert {tuple(r) for r in doc_lines(df).select("k", "line_no", "line", "in_code").collect()} == want


def test_unpaired_symbols(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("()[]'a") for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, para string")
    want = set()
    for k, text in enumerate(texts):
        for a, b in proof.PAIRS:
            stack = []
            for i, c in enumerate(text):
                if c == a:
                    stack.append(i)
                elif c == b and stack:
                    stack.pop()
                elif c == b:
                    want.add((k, i, c))
            want |= {(k, i, a) for i in stack}
    assert {tuple(r) for r in proof.find_unpaired_symbols(df).select("k", "start_pos", "error_text").collect()} == want


def test_link_places(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["[[a]]", "![[b|3x4]]", "[c](d)", "![e](f)", "é", "x ", "]", "\n"]) for _ in range(rng.randrange(20))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = {(k, m.start(), m.end(), m[0]) for k, t in enumerate(texts) for m in re.finditer(r"!?\[\[[^\]]+\]\]|!?\[[^\]\[]+\]\([^)]+\)", t or "")}
    assert {tuple(r) for r in links.extract_links(df).select("k", "pos", "end_pos", "raw").collect()} == want


def test_notes(spark):
    text = "    x\n[^a]: one\n    more\n\n    after blank\nplain\n[^endnote-a]: e\n[^a]:\n\tlast\n[^b]: b\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "[^")], "k int, text string")
    found = {tuple(r) for r in markdown.extract_notes(df).collect()}
    assert found == {(1, "endnote", "a", "e"), (1, "footnote", "a", "last"), (1, "footnote", "b", "b")}


def test_long_documents(spark):
    def seconds(n: int) -> float:
        lines = [f"## h{i}\n| a | b |\n|---|---|\n| {i} | (x |\n\n[^{i}]: n\n    more [[l{i}]] typo\n```\nc\n```" for i in range(n)]
        df = spark.createDataFrame([("\n".join(lines),)], "text string").cache()
        one = spark.createDataFrame([("(typo " * n * 4,)], "para string").cache()
        df.count(), one.count()
        start = time.monotonic()
        assert markdown.extract_tables(df).count() == markdown.extract_notes(df).count() == links.extract_links(df).filter("kind = 'wiki_link'").count() == n
        assert headings.normalize_numbering(df).collect()[0]["text"].count("## ") == n
        assert proof.find_typos(one, {"type": ["typo"]}).count() == proof.find_unpaired_symbols(one).count() == 4 * n
        return time.monotonic() - start

    seconds(500)
    small = seconds(1000)
    assert seconds(8000) < 24 * max(small, 1.0)
