"""Sharding by sampled splitters.

A size-weighted sample of keys, bounded in size, gives quantile boundaries;
records are range-partitioned by them, and ranges that turn out overfull are
subdivided. Exact sums per range then place every record on one line of bytes,
which is cut into shards of equal length: shards differ by one record's size
at most, and no step needs more than one (sub)range in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.text import unit_hash
from docmill.storage import materialise

#: Expected number of sampled keys for each range, and in all at least.
SAMPLE_PER_RANGE, SAMPLE = 32, 20_000
#: Records per range that a task sorts, and ranges at most; the splitters are one row of so many keys.
RANGE_ROWS, MAX_RANGES = 250_000, 1 << 16
#: A range of more than so many times the mean, or the records of a range, is subdivided.
OVERFULL = 2


def range_of(key: Column, cuts: str, ranges: int, rows: DataFrame) -> DataFrame:
    """``rows`` with ``_range``, how many of the sorted ``cuts`` aren't above the key, by binary search; -1 for a null key."""
    found = rows.withColumn("_range", F.lit(0))
    step = 1 << max(0, ranges.bit_length() - 1)
    while step:
        found = found.withColumn("_range", F.col("_range") + F.when(F.get(cuts, F.col("_range") + step - 1) <= key, step).otherwise(0))
        step //= 2
    return found.withColumn("_range", F.when(key.isNull(), -1).otherwise(F.col("_range")))


def by_sampled_splitters(records: DataFrame, key: str, size: str, tie: Column, shards: int, ranges: int | None = None) -> DataFrame:
    """Give each record of ``records`` a ``shard`` (0 to ``shards`` - 1) and a gapless ``slot``; sizes per shard are near equal.

    ``key`` is a numeric column, ``size`` a positive integer column, ``tie``
    orders and spreads records of one key: no two records of a frequent key
    should share it. Null keys form the first range and are subdivided like any
    other. Equal keys, sizes and ties are interchangeable. An empty table gives
    no rows; with fewer records than shards some shards stay empty. Columns
    named ``_range`` to ``_total`` are used inside.
    """
    kept = [c for c in records.columns]
    whole = records.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"), F.count(F.lit(1)).alias("_count"))
    if ranges is None:
        ranges = min(MAX_RANGES, max(16, -(-whole.first()["_count"] // RANGE_ROWS)))
    # Size-weighted: a record is drawn with a chance in proportion to its size.
    drawn = records.crossJoin(F.broadcast(whole)).filter(unit_hash(F.col(key), tie) * F.col("_total") < F.lit(float(max(SAMPLE, SAMPLE_PER_RANGE * ranges))) * F.col(size))
    cuts = [i / ranges for i in range(1, ranges)]
    # One row of at most ``ranges`` - 1 keys; the summary tells quantiles apart that are a quarter of a range from each other.
    splitters = drawn.agg(F.percentile_approx(F.col(key), cuts, max(10_000, 4 * ranges)).alias("_cuts"))
    splitters = splitters.select(F.coalesce(F.array_distinct("_cuts"), F.array().cast(splitters.schema["_cuts"].dataType)).alias("_cuts"))
    ranged = range_of(F.col(key), "_cuts", ranges, records.crossJoin(F.broadcast(splitters))).select(*kept, "_range", F.xxhash64(F.col(key), tie).alias("_tie"))

    # Subdivide what is overfull in rows or bytes; the table has one row per range.
    full = ranged.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    share = F.greatest(F.greatest(F.col("_bytes") / F.col("_total"), F.col("_rows") / F.col("_count")) * ranges, F.col("_rows") / RANGE_ROWS)
    parts = full.crossJoin(F.broadcast(whole)).select("_range", "_bytes", "_rows", F.when(share > OVERFULL, F.ceil(share)).otherwise(F.lit(1)).cast("int").alias("_parts"))
    pieces = ranged.join(F.broadcast(parts.select("_range", "_parts")), "_range").withColumn("_piece", F.pmod("_tie", "_parts").cast("int"))

    # Where each range begins on the line of bytes: one row per range, at most MAX_RANGES + 1. Pieces begin within their range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_bytes", "_rows")))
    totals = pieces.groupBy("_range", "_piece").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    inside = Window.partitionBy("_range").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.join(F.broadcast(begins), "_range").select(
        "_range",
        "_piece",
        (F.col("_bytes_before") + F.coalesce(F.sum("_bytes").over(inside), F.lit(0))).alias("_b0"),
        (F.col("_rows_before") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).alias("_r0"),
    )
    line = Window.partitionBy("_range", "_piece").orderBy(F.col(key), F.col("_tie"), F.col(size))
    placed = (
        pieces.withColumn("_row", F.row_number().over(line))
        .withColumn("_upto", F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["_range", "_piece"])
        .crossJoin(F.broadcast(whole.select("_total")))
    )
    middle = 2 * (F.col("_b0") + F.col("_upto")) - F.col(size)
    placed = placed.select(
        *kept,
        F.least(F.floor(middle * F.lit(shards) / (2 * F.col("_total"))), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("_r0") + F.col("_row")).alias("_rank"),
    )
    placed = materialise(placed)
    # One row per shard.
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(*kept, "shard", (F.col("_rank") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Shard documents by UTF-8 bytes plus one.

    Returns ``doc_id, size, text_crc32, shard, slot``. Null and empty texts
    have size 1. Null ids form a range of their own, repeated ids and rows are
    records like others. Further columns of ``docs`` don't matter.
    """
    text = docs[text_col]
    records = docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    # Written once, so that a row's number stays the same; it parts rows of one id and text.
    return by_sampled_splitters(materialise(records), "doc_id", "size", F.xxhash64("text_crc32", "row_no"), shards, ranges).drop("row_no")
