import duckdb  # noqa: F401
import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, lang); extra columns clash with names used inside the operators."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            for c in ("digest", "norm", "salt", "keep_id", "fp", "key", "row", "kept", "size", "shard", "ids", "start", "length", "w", "lines", "line", "lid", "score", "stratum", "held_out"):
                df = df.withColumn(c, df["doc_id"])
        return df

    return make


#: Null id, null and empty text, ties, repeated rows, a very long text.
ODD = [(1, None), (2, ""), (3, "Same text here"), (4, "same TEXT here"), (4, "same TEXT here"), (None, "same text here"), (None, None), (5, "É É"), (6, "é é"), (7, "word " * 30000), (8, "x" * 90000), (9, " \t\n ")]


@pytest.fixture(scope="session")
def odd():
    return ODD
