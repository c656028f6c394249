"""Heading lines: find, strip and add numbering, rebuild documents. Map-only: a document's counters are a fold over its own lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import bound, number_style, split_on_terminator, strip
from docmill.operators.lines import doc_lines, fenced_lines, scan
from docmill.rules.numbering import CHINESE_NUMS, CIRCLED_1_50, CLEAN_RULES, SCHEMES

HEADING = r"^(#{1,6})(?U:\s)+(.*)$"
LEVELS = 9


def heading_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Headings outside of fences: the other columns, ``line_no, level, heading``."""
    lines = doc_lines(docs, text_col).filter(~F.col("in_code") & F.col("line").rlike(HEADING))
    others = [c for c in docs.columns if c != text_col]
    return lines.select(*others, "line_no", F.char_length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("heading"))


def remove_numbering(x: Column, rules: dict[str, str] = CLEAN_RULES) -> Column:
    """The first rule whose result differs from the stripped text wins."""

    def tried(bare: Column) -> Column:
        found = [bound(F.regexp_replace(bare, "(?U)" + p, ""), lambda r: F.when(r != bare, strip(r))) for p in rules.values()]
        return F.coalesce(*found, bare)

    return bound(strip(x), tried)


def render_number(counters: Column, level: Column, scheme: dict[int, str]) -> Column:
    """The numbering text for a level from an array of nine counters; empty where the scheme has none. A counter of zero shows as 1."""
    out = F.lit("")
    for k, template in scheme.items():
        parts = []
        for piece in re.split(r"(\{\d\.\w+\})", template):
            m = re.fullmatch(r"\{(\d)\.(\w+)\}", piece)
            parts.append(number_style(F.greatest(F.get(counters, F.lit(int(m[1]) - 1)), F.lit(1)), m[2]) if m else F.lit(piece))
        out = F.when(level == k, F.concat(*parts)).otherwise(out)
    return out


def counters_of(levels: Column) -> Column:
    """For an array of levels (null where a line is no heading) the nine counters after each: its own goes up, deeper ones begin again."""

    def step(now: Column, level: Column) -> Column:
        up = F.transform(now, lambda c, i: F.when(i + 1 == level, c + 1).when(i + 1 > level, 0).otherwise(c))
        return F.when(level.isNull(), now).otherwise(up)

    return scan(levels, F.array(*[F.lit(0)] * LEVELS), step, "array<int>")


def _rewrite(docs: DataFrame, text_col: str, clean: Column | None, scheme: dict[int, str] | None, rules: dict[str, str]) -> DataFrame:
    def marked(x: Column) -> Column:
        head = F.when(~x["code"] & x["line"].rlike(HEADING), F.struct(F.regexp_extract(x["line"], HEADING, 1).alias("h"), F.regexp_extract(x["line"], HEADING, 2).alias("t")))
        return F.struct(x["line"].alias("line"), head.alias("head"))

    def line(x: Column, counters: Column | None) -> Column:
        head = x["head"]
        title = remove_numbering(head["t"], rules) if clean is not None else strip(head["t"])
        kept = F.concat_ws(" ", head["h"], title) if clean is not None else x["line"]
        if counters is None:
            return F.when(head.isNull(), x["line"]).otherwise(F.concat_ws(" ", head["h"], title))
        number = render_number(counters, F.char_length(head["h"]), scheme)
        return F.when(head.isNull(), x["line"]).otherwise(bound(number, lambda n: F.when(n == "", kept).otherwise(F.concat(head["h"], F.lit(" "), n, title))))

    def made(lines: Column) -> Column:
        if scheme is None:
            return F.transform(lines, lambda x: line(x, None))
        return F.zip_with(lines, counters_of(F.transform(lines, lambda x: F.char_length(x["head"]["h"]))), line)

    text = F.array_join(bound(F.transform(fenced_lines(F.col(text_col)), marked), made), "\n")
    return docs.select(*(F.when(F.col(text_col).isNotNull(), text).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def remove_numbering_md(docs: DataFrame, text_col: str = "text", rules: dict[str, str] = CLEAN_RULES) -> DataFrame:
    return _rewrite(docs, text_col, F.lit(True), None, rules)


def add_numbering(docs: DataFrame, scheme: str | dict[int, str] = "gongwen_standard", text_col: str = "text") -> DataFrame:
    """Headings with numbers; a level without template keeps its line."""
    return _rewrite(docs, text_col, None, SCHEMES[scheme] if isinstance(scheme, str) else scheme, CLEAN_RULES)


def normalize_numbering(docs: DataFrame, scheme: str | dict[int, str] = "gongwen_standard", text_col: str = "text", rules: dict[str, str] = CLEAN_RULES) -> DataFrame:
    """Old numbers go, new ones come."""
    return _rewrite(docs, text_col, F.lit(True), SCHEMES[scheme] if isinstance(scheme, str) else scheme, rules)


_SEPS = r"[\s\.、，,。]?"
DETECT = (
    (5, rf"^[{CIRCLED_1_50}]", rf"^[{CIRCLED_1_50}]{_SEPS}"),
    (4, r"^(?:[（(][0-9０-９][)）]|\(\d+\))", rf"^[（(][0-9０-９]+[)）]{_SEPS}"),
    (3, r"^[0-9０-９]+[\.．、，,。]", r"^[0-9０-９]+[\.．、，,。]\s*"),
    (2, rf"^[（(][{CHINESE_NUMS}]+[)）]", rf"^[（(][{CHINESE_NUMS}]+[)）]{_SEPS}"),
    (1, rf"^[{CHINESE_NUMS}]+[、,，\.。]", rf"^[{CHINESE_NUMS}]+[、,，\.。]\s*"),
)


def detect_heading_level(x: Column) -> Column:
    """``clean`` text and ``level`` 1 to 5 by the kind of number in front, 0 without."""

    def tried(bare: Column) -> Column:
        out = F.struct(bare.alias("clean"), F.lit(0).alias("level"))
        for level, test, cut in reversed(DETECT):
            out = F.when(bare.rlike("(?U)" + test), F.struct(F.regexp_replace(bare, "(?U)" + cut, "").alias("clean"), F.lit(level).alias("level"))).otherwise(out)
        return out

    return bound(strip(x), tried)


def heading_from_paragraph(x: Column, style_level: Column) -> Column:
    """A paragraph as Markdown: level by its number, else by its style; ``heading`` line (null for level 0) and ``body``."""
    found = detect_heading_level(x)
    return bound(
        found,
        lambda d: bound(
            F.when(d["level"] > 0, d["level"]).otherwise(F.coalesce(style_level, F.lit(0))),
            lambda level: bound(
                split_on_terminator(d["clean"]),
                lambda s: F.struct(
                    level.alias("level"),
                    F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.regexp_replace(s["title"], r"[：:。]$", ""))).alias("heading"),
                    F.when(level > 0, s["body"]).otherwise(d["clean"]).alias("body"),
                ),
            ),
        ),
    )


def headings_from_paragraphs(paras: DataFrame, keys: list[str], scheme: str | dict[int, str] | None = None, order: str = "para_no", text_col: str = "text", style_col: str | None = None) -> DataFrame:
    """``keys, order, level, heading, body`` of a document's paragraphs, old numbers gone; with a scheme headings get new numbers in the document's order. A shuffle by document."""
    style = F.col(style_col) if style_col else F.lit(None).cast("int")
    rows = paras.select(*keys, order, heading_from_paragraph(F.col(text_col), style).alias("h"))
    if scheme is None:
        return rows.select(*keys, order, "h.*")
    templates = SCHEMES[scheme] if isinstance(scheme, str) else scheme
    piled = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col("h.level").alias("level"), F.col("h.heading").alias("heading"), F.col("h.body").alias("body")))).alias("_p"))

    def numbered(p: Column, counters: Column) -> Column:
        head = F.concat(F.repeat(F.lit("#"), p["level"]), F.lit(" "), render_number(counters, p["level"], templates), F.substring(p["heading"], p["level"] + 2, F.char_length(p["heading"])))
        return F.struct(p[order].alias(order), p["level"].alias("level"), head.alias("heading"), p["body"].alias("body"))

    made = F.zip_with("_p", counters_of(F.transform("_p", lambda p: F.when(p["level"] > 0, p["level"]))), numbered)
    return piled.select(*keys, F.explode(made).alias("_p")).select(*keys, "_p.*")
