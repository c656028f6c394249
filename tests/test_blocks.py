"""Blocks of sheets against flood fill."""

import random
from collections import defaultdict

from docmill.operators import sheets


def flood(cells):
    at = defaultdict(set)
    for s, r, c, v in cells:
        if v is not None and v.strip():
            at[s].add((r, c))
    out = []
    for s, left in at.items():
        while left:
            todo, seen = [left.pop()], []
            while todo:
                r, c = todo.pop()
                seen.append((r, c))
                for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if n in left:
                        left.remove(n)
                        todo.append(n)
            rows, cols = zip(*seen, strict=True)
            out.append((s, min(rows), min(cols), max(rows), max(cols)))
    return sorted(out, key=str)


def test_random_sheets_equal_flood_fill(spark, monkeypatch):
    monkeypatch.setattr(sheets, "BAND", 8)
    rnd = random.Random(2)
    cells = [(s if s else None, r, c, rnd.choice(["x", "x", " ", "", None])) for s in range(5) for r in range(40) for c in range(-3, 37) if rnd.random() < 0.2 + 0.15 * s]
    cells += cells[:50]
    # A spiral, whose ends are far apart, and a comb.
    cells += [(9, r, c, "x") for r in range(30) for c in range(30) if r % 2 == 0 or c == (29 if r % 4 == 1 else 0)]
    cells += [(10, r, c, "x") for r in range(30) for c in range(30) if c % 2 == 0 or r == 29]
    got = sheets.find_blocks(spark.createDataFrame(cells, "sheet int, row int, col int, value string"), ["sheet"])
    assert sorted(map(tuple, got.collect()), key=str) == flood(cells)


def test_no_cells(spark):
    empty = spark.createDataFrame([(1, 1, 1, " ")], "sheet int, row int, col int, value string")
    assert sheets.find_blocks(empty, ["sheet"]).count() == 0


def test_one_sheet_of_a_million_cells(spark):
    """Stripes of three rows with a gap of one: many tasks' work, without Python."""
    from pyspark.sql import functions as F

    cells = spark.range(1_000_000).select(F.lit(1).alias("sheet"), (F.floor(F.col("id") / 1000) + F.floor(F.col("id") / 3000)).alias("row"), (F.col("id") % 1000 + F.when(F.col("id") % 1000 >= 500, 2).otherwise(0)).alias("col"), F.lit("v").alias("value"))
    got = sheets.find_blocks(cells, ["sheet"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    boxes = {tuple(r)[1:] for r in got.collect()}
    assert len(boxes) == 2 * 334 and (0, 0, 2, 499) in boxes and (4, 502, 6, 1001) in boxes
