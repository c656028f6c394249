"""Of a group one row stays, whatever its ids; the toxicity sample is bounded."""

from docmill.llm import exact_dedup, near_dedup, toxicity

WORDS = " ".join(f"w{k}" for k in range(60))


def read_back(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_copies_of_one_id_and_without_id(spark, make_docs, tmp_path):
    rows = [(1, "Same")] * 300 + [(None, "other")] * 50 + [(None, "same"), (7, "own"), (None, None), (None, "")]
    got = exact_dedup.drop_copies(read_back(make_docs(rows, extra=True).repartition(7), f"{tmp_path}/d")).collect()
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in got), key=str) == sorted([(1, "same"), (None, "other"), (7, "own"), (None, "")], key=str)


def test_near_copies_of_one_id_and_without_id(spark, make_docs, tmp_path):
    near = [WORDS + f" end{k}" for k in range(20)]
    rows = [(3, t) for t in near] + [(None, t) for t in near] + [(9, "quite another text of seven words")] * 5 + [(None, "nothing like any of the other texts")] * 4
    docs = read_back(make_docs(rows, extra=True).repartition(5), f"{tmp_path}/d")
    out = near_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [3, 9, None]


def test_sample_is_bounded_where_an_id_repeats(spark, make_docs):
    docs = make_docs([(1, f"text {k}") for k in range(500)] + [(2, "b"), (3, "c")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 0)], "doc_id long, toxic int")
    got = toxicity.training_sample(docs, labels, "doc_id", "text", 2).collect()
    assert len(got) == 2
    assert sorted(map(tuple, toxicity.training_sample(docs, labels, "doc_id", "text", 10).collect())) == [(0, "b"), (0, "c"), (1, "text 0")]


def test_harmless_neighbours_are_learned(spark, make_docs):
    bad = [(k, f"you total moron number{k} go home") for k in range(40)]
    fine = [(100 + k, f"plain words here number{k} in a row") for k in range(80)]
    cake = [(200 + k, f"we baked moron cake number{k} today") for k in range(12)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in bad + fine + cake], "doc_id long, toxic int")
    model = toxicity.train(make_docs(bad + fine + cake), labels)
    assert "moron cake" in model.exceptions and "total moron" not in model.exceptions
    got = {r.doc_id: r.predicted for r in toxicity.score(make_docs([(1, "a moron cake for all"), (2, "you total moron go home")]), model).collect()}
    assert got == {1: 0, 2: 1}
