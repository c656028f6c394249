"""Pages and batches: page ranges, splits, merges, categories, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators.ranks import ranked


CATEGORIES = {
    "text": ("md", "txt", "markdown"), "document": ("docx", "doc", "wps", "rtf", "odt"), "spreadsheet": ("xlsx", "xls", "et", "ods", "csv"), "layout": ("pdf", "ofd", "xps", "caj"),
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic", "heif"),
}
PRIORITY = tuple(CATEGORIES)


def category_of(ext: Column) -> Column:
    out = F.lit("unknown")
    for c, exts in CATEGORIES.items():
        out = F.when(F.lower(ext).isin(*exts), c).otherwise(out)
    return out


def parse_page_ranges(x: Column) -> Column:
    """Sorted distinct pages of a text like ``1-3，5;7~10``; null where a part is no page or range."""
    parts = F.filter(F.transform(F.split(F.translate(x, "，；;、～~－—", ",,,,----"), ",", -1), lambda p: F.regexp_replace(p, r"(?U)\s+", "")), lambda p: p != "")
    good = F.forall(parts, lambda p: p.rlike(r"\A[1-9]\d{0,6}(?:-[1-9]\d{0,6})?\z"))

    def pages(p: Column) -> Column:
        a, b = F.substring_index(p, "-", 1).try_cast("int"), F.substring_index(p, "-", -1).try_cast("int")
        return F.sequence(F.least(a, b), F.greatest(a, b))

    return F.when(good & (F.size(parts) > 0), F.array_sort(F.array_distinct(F.flatten(F.transform(F.when(good, parts), pages)))))


def split_pages(pages: DataFrame, chosen: DataFrame, keys: list[str], mode: str = "custom") -> DataFrame:
    """``part`` of every page: its own number, 1 for odd and 2 for even, or 1 for ``chosen(keys, pages)`` and 2 for the rest.

    Documents of which all or no pages are chosen have part 0: they aren't split.
    """
    if mode == "every_page":
        return pages.withColumn("part", F.col("page_no"))
    if mode == "odd_even":
        return pages.withColumn("part", F.when(F.col("page_no") % 2 == 1, 1).otherwise(2))
    rows = pages.join(chosen, keys, "left").withColumn("_in", F.coalesce(F.array_contains("pages", F.col("page_no")), F.lit(False)))
    share = rows.groupBy(*keys).agg(F.min(F.col("_in").cast("int")).alias("_all"), F.max(F.col("_in").cast("int")).alias("_any"))
    rows = rows.join(share, keys)
    return rows.select(*pages.columns, F.when((F.col("_all") == 1) | (F.col("_any") == 0), 0).when(F.col("_in"), 1).otherwise(2).alias("part"))


def merge_pages(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``merged_no``: continuous page numbers of the documents of a group, in order; a group may hold all pages."""
    return ranked(pages, keys, order, "merged_no").withColumn("merged_no", F.col("merged_no").cast("int"))


def categorize_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``path, category, n``: a row for each file with its category and that one's number of files; unknown ones are left out."""
    rows = files.select(F.col(path_col).alias("path"), category_of(F.regexp_extract(path_col, r"\.([^./]+)$", 1)).alias("category")).filter("category <> 'unknown'")
    # One row for each of the fixed categories.
    return rows.join(F.broadcast(rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))), "category").select("path", "category", "n")


def dominant_category(files: DataFrame, keys: list[str], category: str = "category") -> DataFrame:
    """The most frequent category of each group; ties by the fixed priority."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col(category))
    counts = files.filter(rank > 0).groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(category, "n"), F.struct("n", -rank)).alias("s")).select(*keys, f"s.{category}", "s.n")


def batch_summary(results: DataFrame, keys: list[str], continue_on_error: bool = True) -> DataFrame:
    """``total, processed, success, failed, skipped, cancelled`` of files ``file_no, status``; without ``continue_on_error`` those after the first failure don't count as processed."""
    done = F.lit(True)
    if not continue_on_error:
        # One row per job with a failure; the join may split a job of many files.
        first = results.filter("status = 'failed'").groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("file_no").alias("_failed"))
        results = results.join(first, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
        done = F.coalesce(F.col("file_no") <= F.col("_failed"), F.lit(True))
    counts = {s: F.count_if(done & (F.col("status") == s)).alias(s) for s in ("success", "failed", "skipped", "cancelled")}
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(done & F.col("status").isin("success", "failed", "skipped")).alias("processed"), *counts.values())
