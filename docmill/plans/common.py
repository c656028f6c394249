"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Queries:
    """Collects functions (spark, sf_dir) by name, with SQL where there is one."""

    def __init__(self):
        self.QUERIES, self.ORACLES = {}, {}

    def __call__(self, sql: str | None = None):
        def put(f):
            self.QUERIES[f.__name__] = f
            if sql is not None:
                self.ORACLES[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
