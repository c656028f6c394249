"""Ranks within groups of any size: range pieces, their counts, and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.storage import materialise


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, pieces: int | None = None) -> DataFrame:
    """``name`` (long): each row's place from 1 within its group by ``order``, nulls first; rows that tie in all of ``order`` take any order.

    Rows are cut into ranges of (keys, order), so that a group of all rows is many tasks' work. A row's place is its
    place in its piece plus the group's rows in earlier pieces; these counts have a row for a piece and group. Null keys are a group.
    """
    pieces = pieces or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.repartitionByRange(pieces, *keys, *order) if keys or order else rows.repartition(pieces)
    # Written, as a second sampling of ranges might cut elsewhere.
    cut = materialise(cut.withColumn("_piece", F.spark_partition_id()))
    counts = cut.groupBy("_piece", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    # A group's pieces are at most all pieces, whatever its rows.
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_piece").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_piece", *keys).orderBy(*(order or [F.lit(0)])))
    placed = cut.withColumn("_at", place)
    same = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(starts, same).select(*rows.columns, (F.col("_at") + F.col("_start")).cast("bigint").alias(name))
