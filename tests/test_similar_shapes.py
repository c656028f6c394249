"""Shapes that meet by their parts give the lines that a plain loop gives, and no pairs are made."""

import random

import pytest

from docmill.operators import sheets

KIND = "g int, line long, cells array<string>"


@pytest.mark.parametrize("narrow", [12, 4, 0])
def test_parts_equal_the_plain_loop(spark, monkeypatch, narrow):
    monkeypatch.setattr(sheets, "RARE", 2)
    monkeypatch.setattr(sheets, "NARROW", narrow)
    rnd = random.Random(11)

    def line(g):
        sizes = {0: (3, 3), 1: (0, 4), 2: (5, 6)}[g % 3]
        return [rnd.choice(["", " ", None, "b", "c", "*", "hot", "=x", f"v{rnd.randrange(30)}", *"ijklmn"]) for _ in range(rnd.randint(*sizes))]

    base, told = ([(g, i + 1, line(g)) for g in range(4) for i in range(n)] for n in (350, 300))
    got = sheets.most_similar_line(*(spark.createDataFrame(x, KIND) for x in (base, told)), ["g"])
    text = lambda x, k: (x[k] or "").strip() if k < len(x) else ""
    want = []
    for g, i, c in told:
        best = (0.0, 1)
        for h, j, b in base:
            n = max(len(b), len(c))
            if h == g and n and (s := sum(text(b, k) == text(c, k) for k in range(n)) / n) > best[0]:
                best = (s, j)
        want.append((g, i, best[1], best[0]))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_many_shapes_make_no_pairs(spark, monkeypatch):
    """8,000 and 8,000 different lines of frequent values of one group: 64 million pairs otherwise."""
    monkeypatch.setattr(sheets, "RARE", 8)
    rows = spark.range(16000).selectExpr("1 AS g", "id + 1 AS line", "array(string(id div 2 % 20), string(id div 40 % 20), string(id div 800)) AS cells")
    got = sheets.most_similar_line(rows.filter("line % 2 = 1"), rows.filter("line % 2 = 0"), ["g"])
    assert [tuple(r) for r in got.filter("similarity < 1 OR base_line <> line - 1").collect()] == [] and got.count() == 8000
    made = 0
    got.collect()
    plans = [got._jdf.queryExecution().executedPlan().finalPhysicalPlan()]
    while plans:
        node = plans.pop()
        plans += [node.children().apply(i) for i in range(node.children().size())]
        plans += [node.plan()] if "QueryStage" in node.nodeName() else []
        if "Join" in node.nodeName():
            made = max(made, node.metrics().apply("numOutputRows").value())
    assert 8000 <= made < 200_000
