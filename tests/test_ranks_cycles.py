"""Ranks within hot groups; shortest cycles around hubs; corpus folders by content."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.operators.links import link_cycles
from docmill.operators.ranks import ranked
from docmill.sources.files import output_names, packed_file, read_corpus


@pytest.mark.parametrize("hot", [True, False])
def test_ranks_are_gapless_and_spread(spark, hot):
    rnd = random.Random(7)
    rows = [(None if rnd.random() < 0.3 else "h" if hot or rnd.random() < 0.5 else rnd.choice("abc"), rnd.randrange(400), i) for i in range(3000)]
    got = ranked(spark.createDataFrame(rows, "g string, o int, id int"), ["g"], ["o", "id"], "at", pieces=8).collect()
    expected = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            expected[r[2]] = n
    assert {r.id: r["at"] for r in got} == expected and len(got) == len(rows)


def test_rank_of_equal_rows_and_none(spark):
    same = ranked(spark.range(500).select(F.lit(1).alias("g"), F.lit("x").alias("o")), ["g"], ["o"], "at", pieces=4)
    assert sorted(r["at"] for r in same.collect()) == list(range(1, 501))
    assert ranked(spark.createDataFrame([], "g int, o int"), ["g"], ["o"], "at").count() == 0


def test_over_thousand_equal_names(spark):
    names = {r.name for r in output_names(spark.range(1500), ["id"], F.lit("a"), F.lit("s"), F.lit("t"), F.lit("")).collect()}
    assert len(names) == 1500 and {"a_s_t", "a_s_t_001", "a_s_t_999", "a_s_t_1000", "a_s_t_1499"} <= names


def shortest(edges, depth):
    out = {}
    step = {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    for node in step:
        ends = {node}
        for length in range(1, depth + 1):
            ends = set().union(*(step.get(e, set()) for e in ends))
            if node in ends:
                out[node] = length
                break
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("depth", [1, 2, 3, 4, 6])
def test_cycles_against_walks(spark, seed, depth):
    rnd = random.Random(seed)
    nodes, loose = 40, (0.01, 0.03, 0.08)[seed]
    edges = [(str(a), str(b)) for a in range(nodes) for b in range(nodes) if rnd.random() < (loose if a != b else 0.02)]
    edges += [("hub", str(b)) for b in range(0, nodes, 2)] + [(str(b), "hub") for b in range(1, nodes, 2)] + [("x", None)]
    got = link_cycles(spark.createDataFrame(edges, "source string, target string"), depth).collect()
    assert {r["node"]: r["length"] for r in got} == shortest([e for e in edges if e[1]], depth) and len(got) == len({r["node"] for r in got})


def test_a_hub_of_all_notes(spark):
    """Each of 100,000 notes links the hub and is linked by it; pairs around it would be ten thousand millions."""
    n = spark.range(100_000).select(F.col("id").cast("string").alias("n"))
    edges = n.select(F.lit("hub").alias("source"), F.col("n").alias("target")).union(n.select("n", F.lit("hub")))
    assert link_cycles(edges).groupBy("length").count().collect() == [(2, 100_001)]


def test_a_hub_passed_one_way(spark):
    """Half of the notes link the hub, the other half is linked by it, and each of these links one of the first: cycles of three."""
    n = spark.range(20_000).select("id")
    a, b = F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id")
    edges = n.select(a.alias("source"), F.lit("hub").alias("target")).union(n.select(F.lit("hub"), b)).union(n.select(b, a))
    assert link_cycles(edges).groupBy("length").count().collect() == [(3, 40_001)]


def test_corpus_by_content(spark, tmp_path):
    root = tmp_path / "node_modules" / "in"  # a folder above that would be ignored below
    for name, content in {"a.md": b"# x\n", "b.bin": b"# x\n", "c.txt": b"\x00" * 40, "d.xyz": packed_file({"xl/workbook.xml": "", "[Content_Types].xml": ""}), "e.pdf": b"%PDF-1.7", "empty.md": b"", "node_modules/f.md": b"# x\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    assert {r[0] for r in read_corpus(spark, str(root)).select(name).collect()} == {"a.md", "c.txt", "e.pdf"}
    found = dict(read_corpus(spark, str(root), detected=True).select(name, "detected").collect())
    assert found["a.md"] == found["b.bin"] == "md" and found["d.xyz"] == "xlsx" and "f.md" not in found


def test_merge_of_many_groups(spark):
    """Groups of any key and size, more than a task passes on at once, equal the plain merge of each."""
    from docmill.operators import sheets

    rnd = random.Random(3)
    keys = [None, 2**60 + 1, *range(700)]
    line = lambda: [rnd.choice(["", " ", "a", "1", "1.0", "b"]) for _ in range(rnd.randrange(4))]
    groups = {k: ([line() for _ in range(rnd.randrange(6))], [line() for _ in range(rnd.randrange(6))]) for k in keys}
    side = lambda s: spark.createDataFrame([(k, n, cells) for k, g in groups.items() for n, cells in enumerate(g[s])], "k long, line long, cells array<string>")
    before, sheets.OUT_ROWS = sheets.OUT_ROWS, 50
    try:
        got = {}
        for r in sheets.merge_by_row(side(0), side(1), ["k"]).orderBy("line").collect():
            got.setdefault(r["k"], []).append(r["cells"])
    finally:
        sheets.OUT_ROWS = before
    assert got == {k: merged for k, g in groups.items() if (merged := sheets._grid_merge(*g))}
    none = spark.createDataFrame([], "k long, line long, cells array<string>")
    assert sheets.merge_by_row(none, none, ["k"]).collect() == []
