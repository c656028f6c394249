"""Map-only operators on streams.

The operators that need no shuffle take a streaming DataFrame as they are; this
module only says which, and starts one for tests and small jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType

from docmill.functions import text as T
from docmill.operators import headings, invoices, markdown, paragraphs, proof
from docmill.operators import links as _links
from docmill.sources import files

#: Functions of a text.
SCALAR: dict[str, Callable[[Column], Column]] = {
    "clean_text": T.clean_text,
    "is_value_empty": lambda x: T.is_value_empty(x, StringType()),
    "process_list_field": lambda x: T.process_list_field(T.parse_list_literal(x)),
    "normalize_date": T.normalize_date,
    "format_cn_date": T.format_cn_date,
    "is_valid_date_text": T.is_valid_date_text,
    "to_halfwidth_digits": T.to_halfwidth_digits,
    "has_chinese": T.has_chinese,
    "has_east_asian": T.has_east_asian,
    "is_fraction": T.is_fraction,
    "is_numeric_string": T.is_numeric_string,
    "strip_inline_marks": T.strip_inline_marks,
    "split_front_matter": markdown.split_front_matter,
    "detect_heading_level": headings.detect_heading_level,
}


def _of_text(f: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn("value", f(F.col("text")))


#: Operators without state: a DataFrame, and their dictionary where they take one, to a DataFrame. Scalar functions add a column ``value``.
STATELESS: dict[str, Callable[..., DataFrame]] = {
    **{name: _of_text(f) for name, f in SCALAR.items()},
    "find_typos": lambda docs, typos: proof.find_typos(proof.split_paragraphs(docs), typos),
    "find_sensitive": lambda docs, words: proof.find_sensitive(proof.split_paragraphs(docs), words),
    "type_csv_cells": lambda docs: files.type_csv_cells(docs.withColumn("value", F.col("text"))),
    "split_paragraphs": proof.split_paragraphs,
    "heading_lines": headings.heading_lines,
    "add_numbering": headings.add_numbering,
    "remove_numbering": headings.remove_numbering_md,
    "normalize_numbering": headings.normalize_numbering,
    "find_wrong_symbols": lambda docs: proof.find_wrong_symbols(proof.split_paragraphs(docs)),
    "find_unpaired_symbols": lambda docs: proof.find_unpaired_symbols(proof.split_paragraphs(docs)),
    "extract_tables": markdown.extract_tables,
    "extract_notes": markdown.extract_notes,
    "note_references": markdown.note_references,
    "extract_formulas": markdown.extract_formulas,
    "invoice_header": invoices.invoice_header,
    "paragraph_features": paragraphs.paragraph_features,
    "extract_links": _links.extract_links,
}


def start(stream: DataFrame, operator: str, path: str, checkpoint: str, *given) -> StreamingQuery:
    """Append an operator's rows to Parquet files; each input row is worked on once. ``given``: what the operator takes besides the stream."""
    return STATELESS[operator](stream, *given).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
