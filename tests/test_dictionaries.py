"""Large dictionaries, joined by grams, against the scan of small ones."""

import random
import time

import pytest
from docmill.operators import proof


@pytest.fixture(scope="module")
def paras(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcAé字") for _ in range(rnd.randrange(1, 9)))
    rows = [(k % 90 if k % 9 else None, k % 4, rnd.choice(["", " ", "x"]).join(word() for _ in range(rnd.randrange(0, 30)))) for k in range(300)] + [(1, 1, None), (2, 2, "")]
    return spark.createDataFrame(rows + rows[:20], "doc_id int, para_no int, para string"), [word() for _ in range(400)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_joined_typos_equal_the_scan(spark, paras):
    df, words = paras
    typos = {f"c{k}": [w, w[::-1]] for k, w in enumerate(words[:150])} | {"none": [""]}
    want = proof.find_typos(df, typos)
    got = proof.find_typos(df, proof.dictionary_frame(spark, typos), keys=["doc_id", "para_no"])
    # A pair that the dictionary repeats counts once in a table.
    assert want.columns == got.columns and set(rows(want)) == set(rows(got)) and len(rows(got)) > 1000
    assert rows(proof.find_typos(df, proof.dictionary_frame(spark, {"a": []}))) == []


def test_joined_words_equal_the_scan(spark, paras):
    df, words = paras
    sensitive = {w: [w + "b", "a" + w, "zz", ""] if k % 2 else [] for k, w in enumerate(dict.fromkeys(words[:120]))}
    want = rows(proof.find_sensitive(df, sensitive))
    table = spark.createDataFrame([(w, ex or None) for w, ex in sensitive.items()] + [(None, None), ("", ["x"])], "word string, exceptions array<string>")
    assert rows(proof.find_sensitive(df, table, keys=["doc_id", "para_no"])) == want and len(want) > 500


def test_time_hardly_grows_with_the_dictionary(spark, paras):
    df, words = paras
    took = []
    for n in (1_000, 1_000, 100_000):
        typos = spark.range(n).selectExpr("concat(substr(sha2(CAST(id AS STRING), 256), 1, 9)) AS wrong", "'c' AS correct").unionByName(proof.dictionary_frame(spark, {"c": words[:50]}))
        began = time.time()
        found = proof.find_typos(df, typos, keys=["doc_id", "para_no"]).count()
        took.append(time.time() - began)
        assert found > 500
    assert took[2] < 4 * took[1] + 3
