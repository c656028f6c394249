import pytest

from docmill import streaming

GIVEN = {"find_typos": {"好": ["坏"], "word": ["词"]}, "find_sensitive": {"中文": ["中文版"]}}
TEXT = "# 一、 a\n[x](u)\n```\n# b\n```\n\n中文１, (词\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n文[^1]\n\n[^1]: 注\n\n$x + y$\n"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    spark.createDataFrame([(1, 0, TEXT), (2, 0, None), (3, 0, "")], "doc_id long, para_no int, text string").write.parquet(path)
    return path


@pytest.mark.parametrize("name", streaming.STATELESS)
def test_a_stream_gives_the_rows_of_a_table(spark, source, tmp_path, name):
    kind = "doc_id long, para_no int, text string"
    fit = lambda rows: rows if name == "paragraph_features" else rows.drop("para_no")
    given = [GIVEN[name]] if name in GIVEN else []
    streaming.start(fit(spark.readStream.schema(kind).parquet(source)), name, str(tmp_path / "out"), str(tmp_path / "c"), *given).awaitTermination(60)
    streamed = spark.read.parquet(str(tmp_path / "out")).collect()
    table = streaming.STATELESS[name](fit(spark.read.schema(kind).parquet(source)), *given).collect()
    assert len(streamed) >= 1 and sorted(map(repr, streamed)) == sorted(map(repr, table))
