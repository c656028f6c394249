"""Exact dedup by skew-safe combining.

Three combining steps compare whole normalised texts, never only digests:
each map task folds its own equal texts (partial aggregation), the task's rows
then meet in groups of digest and salt, and the salts' winners meet last. A
group of copies of any size therefore sends one row per task to a salt and one
row per salt to the last step. Rows find their group again by digest in a join
that Spark may split by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.text import ascii_lower


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, keep_row: bool = False) -> DataFrame:
    """Decide for every row of ``docs`` whether it stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, and with
    ``keep_row`` the whole input row as struct ``row`` and ``stays``. Other columns of
    ``docs`` don't matter, whatever their names. ``stays`` tells one row of a
    group then, by its place, also among rows of one id; ``docs`` must be as
    read from files, where a row's place is the same in every scan.

    Null text counts as empty, empty texts are equal to each other. The row
    with the largest id stays; null ids lose to any id, and a group of null
    ids only has ``keep_id`` null and keeps them. Rows that repeat id and text
    count in ``group_size`` and share the decision. An empty table gives no rows.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    named = docs.select(docs[id_col].alias("doc_id"), ascii_lower(text).alias("norm"), *([F.struct("*").alias("row")] if keep_row else []))
    rows = named.withColumn("digest", F.sha2("norm", 256))
    if keep_row:
        rows = rows.withColumn("place", F.monotonically_increasing_id())

    def best(id_col: str) -> list:
        """The place of one row of the largest id; of null ids only, the first."""
        return [F.coalesce(F.max_by("place", id_col), F.min("place")).alias("place")] if keep_row else []

    placed = ["place"] if keep_row else []

    salted = (
        rows.select("doc_id", "norm", "digest", *placed, (F.spark_partition_id() % salts).alias("salt"))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), *best("doc_id"))
    )
    contents = salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), *best("keep_id"))
    groups = contents.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("group_size"), F.count(F.lit(1)).alias("contents"), *best("keep_id"))
    clash = F.raise_error(F.concat(F.lit("two texts share the digest "), F.col("digest")))
    # A key of its own makes Spark exchange both sides of the join, which it can then split where one digest is hot.
    groups = groups.select(
        F.unhex("digest").alias("key"), "keep_id", F.when(F.col("contents") == 1, F.col("group_size")).otherwise(clash.cast("bigint")).alias("group_size"), *(F.col(c).alias("best") for c in placed)
    )
    members = rows.select("doc_id", F.unhex("digest").alias("key"), *(["row", "place"] if keep_row else []))
    return members.join(groups, "key").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
        *(["row", (F.col("place") == F.col("best")).alias("stays")] if keep_row else []),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the largest id, whatever ids are null or repeat; same columns. ``docs`` as read from files."""
    return exact_dedup(docs, id_col, text_col, keep_row=True).filter("stays").select("row.*")
