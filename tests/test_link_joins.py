"""Joins of links on large tables are sorted, not broadcast through the driver."""

import pytest

from docmill.operators import links
from docmill.plans.markdown_queries import L6_link_cycles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    seen, write = [], links.materialise
    monkeypatch.setattr(links, "materialise", lambda df: seen.append(plan(df)) or write(df))
    return seen


def test_no_step_of_link_cycles_is_broadcast(spark, plans):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    found = L6_link_cycles(spark, "/root/testdata/sf0.001")
    assert found.count() > 50 and sum(p.count("SortMergeJoin") for p in plans) >= 6
    assert not any("Broadcast" in p for p in plans)


def test_longer_cycles_and_embeds_are_not_broadcast(spark, plans):
    ring = spark.createDataFrame([(str(k), str((k + 1) % 6)) for k in range(6)], "source string, target string")
    found = links.link_cycles(ring, 6)
    assert {r["length"] for r in found.collect()} == {6} and "Broadcast" not in plan(found)
    docs = spark.createDataFrame([("a.md", "x ![[b]]"), ("b.md", "y ![[a]]")], "path string, text string")
    assert dict(map(tuple, links.expand_embeds(docs).collect())) == {"a.md": "x y [cycle: a]", "b.md": "y x [cycle: b]"}
    assert not any("Broadcast" in p for p in plans)
