"""Large dictionaries meet texts without the texts' runs of signs or any unverified words being exchanged."""

import random

import pytest

from docmill.operators import proof


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abé字𝕏") for _ in range(rnd.randrange(1, 10)))
    words = list(dict.fromkeys([word() for _ in range(150)] + ["aaa", "abab", "ababab", "bab", "aaaaaaaa"]))
    texts = [rnd.choice(["", " ", "ab"]).join(rnd.choice(words) for _ in range(rnd.randrange(0, 12))) for _ in range(80)] + ["a" * 30, "ab" * 20, "", None]
    return spark.createDataFrame([(k % 20, t) for k, t in enumerate(texts)], "doc_id int, para string"), {f"c{k}": [w] for k, w in enumerate(words)}


@pytest.mark.parametrize("limit", [200_000, 3])
def test_words_of_any_number_equal_the_scan(spark, made, monkeypatch, limit):
    paras, typos = made
    want = sorted(map(tuple, proof.find_typos(paras, typos).collect()), key=str)
    monkeypatch.setattr(proof, "BROADCAST_WORDS", limit)
    got = proof.find_typos(paras, proof.dictionary_frame(spark, typos | {"none": [""]}))
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 1000


def test_only_words_that_are_there_are_exchanged(spark, monkeypatch):
    """A thousand words of one beginning, of which a text has one: the rows that are joined are the hits."""
    monkeypatch.setattr(proof, "BROADCAST_WORDS", 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check_exchanges(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def check_exchanges(spark):
    paras = spark.createDataFrame([(k, "x" * 50 + f" beginning{k % 1000:04} ") for k in range(2000)], "doc_id int, para string")
    typos = spark.range(1000).selectExpr("concat('beginning', lpad(id, 4, '0')) AS wrong", "'c' AS correct")
    found = proof.find_typos(paras, typos)
    rows = found.collect()
    assert sorted((r.doc_id, r.start_pos, r.error_text) for r in rows) == [(k, 51, f"beginning{k % 1000:04}") for k in range(2000)]
    written, plans = [], [found._jdf.queryExecution().executedPlan().finalPhysicalPlan()]
    while plans:
        node = plans.pop()
        plans += [node.children().apply(i) for i in range(node.children().size())]
        plans += [node.plan()] if node.nodeName().startswith("ShuffleQueryStage") else []
        if node.nodeName() == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
    assert written and max(written) < 2100
