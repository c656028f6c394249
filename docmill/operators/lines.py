"""Documents as lines, with what is fenced code; no shuffle, time linear in a document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import bound, owned, scan  # noqa: F401


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def fenced_lines(text: Column, fence: str = "```") -> Column:
    """Array of ``line`` and ``code``: whether it is a fence or lies after an odd number of them. Null is one empty line.

    The text is cut before every fence, so that a line's piece tells the number of fences above it.
    """
    pieces = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), rf"\n(?={fence})", -1)

    def of_piece(piece: Column, k: Column) -> Column:
        own = bound(F.split(piece, "\n", -1), lambda ls: F.when(k == 0, F.slice(ls, F.lit(2), F.size(ls))).otherwise(ls))
        return F.transform(own, lambda x, i: F.struct(x.alias("line"), ((k % 2 == 1) | ((k > 0) & (i == 0))).alias("code")))

    return F.flatten(F.transform(pieces, of_piece))


def doc_lines(docs: DataFrame, text_col: str = "text", fence: str = "```") -> DataFrame:
    """All columns but the text, ``line_no`` from 0, ``line`` and ``in_code``."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, F.posexplode(fenced_lines(docs[text_col], fence)).alias("line_no", "_x"))
    return rows.select(*others, "line_no", F.col("_x.line").alias("line"), F.col("_x.code").alias("in_code"))
