"""Long runs of one sign through every operator over texts: no crash, and time linear in the run."""

import time

import pytest
from docmill.functions import text as X
from docmill.operators import headings, invoices, links, markdown, paragraphs, proof, sheets
from pyspark.sql import functions as F

N = 20_000
HEAD = "发票号码：1\n项目名称 规格型号 单 位 数 量 单 价 金 额 税率/征收率 税 额\n*a*b"
RUNS = {
    "blanks": "a" + " " * N + "b",
    "wide blanks": "a" + " 　" * (N // 2) + "b",
    "back-quotes": "`" * N,
    "code spans": "`a`" * N,
    "embeds": "![" * N,
    "wiki embeds": "x ![[" * N + "]",
    "links": "[a](" * N,
    "pipes": "|" * N + "\n" + "|-" * N + "|\n" + "|" * N,
    "blank cells": "|" + " |" * N + "\n|" + " - |" * N + "\n|" + " |" * N,
    "sizes": HEAD + " 3x4" * N + " 盒 1 2 3 13% 0.4\n合计",
    "lines": "\n" * N,
    "digits": "1" * N,
    "x": "x" * N,
    "brackets": "(" * N + "[^" * N,
}

COLUMNS = {
    "strip": X.strip,
    "clean_text": X.clean_text,
    "strip_inline_marks": X.strip_inline_marks,
    "normalize_date": X.normalize_date,
    "to_number": X.to_number,
    "remove_brackets": X.remove_brackets,
    "split_copy_to": lambda x: F.size(X.split_copy_to(x)),
    "attachment_name": X.attachment_name,
    "split_on_terminator": lambda x: X.split_on_terminator(x).cast("string"),
    "remove_numbering": headings.remove_numbering,
    "detect_heading_level": headings.detect_heading_level,
    "normalize_cell": lambda x: sheets.normalize_cell(x)["key"],
    "merged_value": lambda x: sheets.merged_value(x, x),
    "front_matter": lambda x: F.size(F.from_json(F.to_json(F.struct(markdown.split_front_matter(x).alias("a"))), "map<string,string>")),
    "extract_section": lambda x: markdown.extract_section(x, F.lit("a")),
    "extract_block": lambda x: markdown.extract_block(x, F.lit("a")),
    "parse_target": lambda x: links.parse_target(x)["path"],
    "rewrite_links": lambda x: links.rewrite_links(x, embeds="placeholder"),
    "ocr_amount": invoices.ocr_amount,
}
FRAMES = {
    "extract_tables": markdown.extract_tables,
    "extract_notes": markdown.extract_notes,
    "note_references": markdown.note_references,
    "extract_formulas": markdown.extract_formulas,
    "extract_links": links.extract_links,
    "heading_lines": headings.heading_lines,
    "normalize_numbering": headings.normalize_numbering,
    "paragraphs": proof.split_paragraphs,
    "typos": lambda d: proof.find_typos(d, {"this": ["thsi", "x", "|", "`"]}, "text"),
    "unpaired": lambda d: proof.find_unpaired_symbols(d, para="text"),
    "sensitive": lambda d: proof.find_sensitive(d, {"x": ["xy"], "[": []}, "text"),
    "features": lambda d: paragraphs.paragraph_features(d.withColumn("para_no", F.lit(0))),
    "invoice_header": invoices.invoice_header,
    "invoice_lines_from_text": lambda d: invoices.invoice_lines_from_text(d, ["doc_id"]),
    "placeholders": sheets.template_placeholders,
}
#: Seconds for one text of a run; squares of it would take minutes.
MOST = 60


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("runs") / "t")
    spark.createDataFrame(list(enumerate(RUNS.values())), "doc_id long, text string").repartition(len(RUNS)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", [*COLUMNS, *FRAMES])
def test_long_runs(spark, texts, name):
    began = time.time()
    out = texts.select("doc_id", COLUMNS[name](F.col("text")).alias("out")) if name in COLUMNS else FRAMES[name](texts)
    out.write.format("noop").mode("overwrite").save()
    assert time.time() - began < MOST, f"{time.time() - began:.0f} s"
