"""Markdown taken apart into rows: front matter, tables, notes, formulas, sections. Map-only unless said otherwise."""

from __future__ import annotations

import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import bound, is_numeric_string, strip
from docmill.operators.lines import fenced_lines, owned, text_lines

FRONT = r"\A(?s)\x{FEFF}?---\s*\n(.*?)\n---[ \t]*(?:\n|\z)(.*)\z"


def split_front_matter(text: Column) -> Column:
    """``yaml`` and ``body``; without front matter the yaml is empty and the body is the stripped text."""
    there = text.rlike(FRONT)
    return F.struct(F.when(there, F.regexp_extract(text, FRONT, 1)).otherwise("").alias("yaml"), F.when(there, strip(F.regexp_extract(text, FRONT, 2))).otherwise(strip(text)).alias("body"))


#: Lists and mappings that a front matter may nest; deeper ones, and those that hold themselves, are no front matter.
NESTED = 50


def _yaml_lists(source: str | None) -> dict[str, list[str]]:
    def listed(v, depth: int = 0) -> list[str]:
        if depth > NESTED:
            raise ValueError("nested too deeply")
        if v is None:
            return []
        if isinstance(v, (list, tuple)):
            return [s for x in v for s in listed(x, depth + 1)]
        return [str(v).lower() if isinstance(v, bool) else str(v)]

    try:
        found = yaml.safe_load((source or "").replace("\t", "  "))
        return {str(k): listed(v) for k, v in found.items()} if isinstance(found, dict) else {}
    except (yaml.YAMLError, ValueError, TypeError, OverflowError, RecursionError):
        return {}


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def parse_front_matter(source: pd.Series) -> pd.Series:
    """YAML text as map of lists of texts; what is no YAML mapping, or can't be read as one (no such date, a list in itself), is empty."""
    return source.map(_yaml_lists)


def resolve_title(record: Column, stem: Column, title_keys: tuple[str, ...] = ("标题", "title", "Title"), default: str = "") -> Column:
    """The first title key's value, else the first alias, else the file's stem, else ``default``."""

    def first(k: str) -> Column:
        v = F.get(record[k], F.lit(0))
        return F.when(strip(v) != "", v)

    return F.coalesce(*(first(k) for k in title_keys), first("aliases"), F.when(strip(stem) != "", stem), F.lit(default))


def is_table_rule(line: Column) -> Column:
    """Whether a line is pipes with dashes, colons and blanks between them, each cell with a dash; two plain patterns that don't nest."""
    return line.rlike(r"^[> \t]*\|[\s:\-|]*\|\s*$") & ~line.rlike(r"\|[\s:]*\|")


def _cells(line: Column) -> Column:
    parts = F.split(F.replace(F.regexp_replace(line, r"^[> \t]+", ""), F.lit("\\|"), F.lit("")), r"\|", -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.transform(inner, lambda c: F.replace(strip(c), F.lit(""), F.lit("|")))


def extract_tables(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Pipe tables outside of fences: the other columns, ``table_no, headers, alignments, rows, start_line, end_line``.

    A table is a run of lines with pipes at both ends; its first line may have text before the first pipe, and text after a
    line's last pipe ends it. Rows are cut or filled up to the header's width.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = docs.filter(F.contains(text_col, F.lit("|")))

    def tables(ls: Column) -> Column:
        goes_on = F.transform(ls, lambda x, i: (i > 0) & x["line"].rlike(r"^[> \t]*\|.*\|") & F.get(ls, i - 1)["line"].rlike(r"\|.*\|$"))
        runs = F.filter(owned(goes_on), lambda r: (r["until"] - r["at"] >= 3) & ~F.get(ls, r["at"])["code"] & is_table_rule(F.get(ls, r["at"] + 1)["line"]))
        return F.transform(runs, lambda r: F.struct(r["at"].alias("at"), F.transform(F.slice(ls, r["at"] + 1, r["until"] - r["at"]), lambda x: x["line"]).alias("ls")))

    good = bound(fenced_lines(F.col(text_col), " {0,3}(?:```|~~~)"), tables)

    def table(t: Column) -> Column:
        head = F.regexp_replace(F.get(t["ls"], F.lit(0)), r"^[^|]*(?=\|)", "")

        def filled(h: Column) -> Column:
            width = F.size(h)

            def row(line: Column) -> Column:
                c = _cells(F.regexp_extract(line, r"^(.*\|)", 1))
                return F.slice(F.concat(c, F.array_repeat(F.lit(""), width)), F.lit(1), width)

            marks = F.transform(
                _cells(F.get(t["ls"], F.lit(1))),
                lambda c: F.when(c.startswith(":") & c.endswith(":"), "center").when(c.startswith(":"), "left").when(c.endswith(":"), "right").otherwise("default"),
            )
            return F.struct(
                h.alias("headers"),
                F.slice(F.concat(marks, F.array_repeat(F.lit("default"), width)), F.lit(1), width).alias("alignments"),
                F.transform(F.slice(t["ls"], F.lit(3), F.size(t["ls"]) - 2), row).alias("rows"),
                t["at"].alias("start_line"),
                (t["at"] + F.size(t["ls"])).alias("end_line"),
            )

        return bound(_cells(head), filled)

    found = rows.select(*others, F.posexplode(F.transform(good, table)).alias("table_no", "_t"))
    return found.select(*others, "table_no", "_t.*").filter(F.size("headers") > 0)


def table_cells(tables: DataFrame) -> DataFrame:
    """``row_no, col_no, header, value`` of every data cell."""
    others = [c for c in tables.columns if c not in ("headers", "alignments", "rows", "start_line", "end_line")]
    rows = tables.select(*others, "headers", F.posexplode("rows").alias("row_no", "_r"))
    return rows.select(*others, "row_no", "headers", F.posexplode("_r").alias("col_no", "value")).select(*others, "row_no", "col_no", F.get("headers", F.col("col_no")).alias("header"), "value")


def table_columns(tables: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, header, values``: all tables of a document as one; a header that comes again appends. One shuffle on (keys, header)."""
    cells = table_cells(tables)
    piled = cells.groupBy(*keys, "header").agg(F.sort_array(F.collect_list(F.struct("table_no", "row_no", "col_no", "value"))).alias("_v"))
    kind = lambda v: F.when(is_numeric_string(v), "number").otherwise("text")
    return piled.select(*keys, "header", F.transform("_v", lambda v: F.struct(v["value"].alias("value"), kind(v["value"]).alias("vtype"))).alias("values"))


NOTE = r"^\[\^([^\]]+)\]:\s*(.*)$"


def extract_notes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, note_id, content`` of the note definitions of every document; of one id the last wins. Indented lines, and blank ones before them, belong to the note above."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.filter(F.contains(text_col, F.lit("[^")))

    def notes(ls: Column) -> Column:
        indented = lambda x: F.coalesce(x.rlike(r"^(?: {4}|\t)"), F.lit(False))
        belongs = F.transform(ls, lambda x, i: indented(x) | (x.rlike(r"^\s*$") & indented(F.get(ls, i + 1))))

        def note(r: Column) -> Column:
            line = F.get(ls, r["at"])
            more = F.slice(ls, r["at"] + 2, r["until"] - r["at"] - 1)
            first = F.array(strip(F.regexp_extract(line, NOTE, 2)))
            content = F.array_join(F.concat(F.filter(first, lambda x: x != ""), F.transform(more, lambda x: F.regexp_replace(x, r"^(?: {4}|\t)", ""))), "\n")
            name = strip(F.regexp_extract(line, NOTE, 1))
            is_end = name.startswith("endnote-")
            return F.struct(
                F.when(is_end, "endnote").otherwise("footnote").alias("kind"), F.when(is_end, F.substring(name, 9, 1 << 30)).otherwise(name).alias("note_id"), r["at"].alias("at"), strip(content).alias("content")
            )

        return F.array_sort(F.transform(F.filter(owned(belongs), lambda r: F.get(ls, r["at"]).rlike(NOTE)), note))

    def last(ns: Column) -> Column:
        """Of notes in the order of their ids and places."""
        return F.filter(ns, lambda a, i: ~(F.get(ns, i + 1)["kind"].eqNullSafe(a["kind"]) & F.get(ns, i + 1)["note_id"].eqNullSafe(a["note_id"])))

    found = rows.select(*others, F.explode(bound(bound(text_lines(F.col(text_col)), notes), last)).alias("n"))
    return found.select(*others, "n.kind", "n.note_id", "n.content")


def note_references(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``ref_no, kind, note_id`` of every reference ``[^id]`` that is no definition, in order."""
    others = [c for c in docs.columns if c != text_col]
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"\[\^((?=[^\]])[^\]\[]*(?:\[[^\]\[]*){0,8})\](?!:)"), F.lit(1))
    rows = docs.select(*others, F.posexplode(found).alias("ref_no", "_id"))
    is_end = F.col("_id").startswith("endnote-")
    return rows.select(*others, "ref_no", F.when(is_end, "endnote").otherwise("footnote").alias("kind"), F.when(is_end, F.substring("_id", 9, 1 << 30)).otherwise(F.col("_id")).alias("note_id"))


def number_notes(refs: DataFrame, defs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kind, note_id, number``: defined notes in the order of their first reference; undefined references have no number."""
    first = refs.groupBy(*keys, "kind", "note_id").agg(F.min("ref_no").alias("ref_no"))
    known = first.join(defs.select(*keys, "kind", "note_id", F.lit(True).alias("_known")), [*keys, "kind", "note_id"], "left")
    order = Window.partitionBy(*keys, "kind", F.col("_known").isNull()).orderBy("ref_no")
    return known.select(*keys, "kind", "note_id", F.when(F.col("_known"), F.row_number().over(order)).alias("number"))


def render_notes(defs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block``: definitions renumbered from 1 by sorted id within their kind; continuation lines are indented by four blanks."""
    order = Window.partitionBy(*keys, "kind").orderBy(F.expr("try_cast(note_id AS bigint)"), "note_id")
    rows = defs.withColumn("_n", F.row_number().over(order))
    line = F.concat(F.lit("[^"), F.when(F.col("kind") == "endnote", "endnote-").otherwise(""), "_n", F.lit("]: "), F.replace("content", F.lit("\n"), F.lit("\n    ")))
    piled = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("kind") == "endnote", "_n", line.alias("l")))).alias("_v"))
    return piled.select(*keys, F.array_join(F.transform("_v", lambda v: v["l"]), "\n").alias("block"))


FORMULA = r"(?s)\$\$(.+?)\$\$|(?<![\\$])\$(?!\$)([^$\n]+?)(?<!\\)\$(?!\$)"


def extract_formulas(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``n, is_inline, latex`` of ``$$..$$`` blocks and ``$..$`` outside of them, in order; line feeds become blanks unless an environment begins."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(FORMULA), F.lit(0))).alias("n", "_x"))
    block = F.col("_x").startswith("$$")
    bare = strip(F.when(block, F.expr("substring(_x, 3, char_length(_x) - 4)")).otherwise(F.expr("substring(_x, 2, char_length(_x) - 2)")))
    return rows.select(*others, "n", (~block).alias("is_inline"), F.when(F.contains(bare, F.lit("\\begin")), bare).otherwise(F.replace(bare, F.lit("\n"), F.lit(" "))).alias("latex"))


def extract_section(text: Column, heading: Column) -> Column:
    """The section under a heading up to the next of the same or a higher level, without trailing blank lines; null where the heading is missing. Case and blanks don't matter."""
    folded = lambda x: F.replace(F.lower(strip(x)), F.lit(" "), F.lit(""))
    pattern = r"^(#{1,9})\s+(.*)$"

    def cut(ls: Column) -> Column:
        here = F.sequence(F.lit(0), F.size(ls) - 1)
        level = lambda i: F.char_length(F.regexp_extract(F.get(ls, i), pattern, 1))
        start = F.get(F.filter(here, lambda i: F.get(ls, i).rlike(pattern) & (folded(F.regexp_extract(F.get(ls, i), pattern, 2)) == folded(heading))), F.lit(0))

        def until(s: Column) -> Column:
            ends = F.filter(here, lambda i: (i > s) & F.get(ls, i).rlike(pattern) & (level(i) <= level(s)))
            part = F.slice(ls, s + 1, F.coalesce(F.get(ends, F.lit(0)), F.size(ls)) - s)
            return F.regexp_replace(F.array_join(part, "\n"), r"(?:\n\s*)+\z", "")

        return bound(start, lambda s: F.when(s.isNotNull(), until(s)))

    return bound(text_lines(text), cut)


def extract_block(text: Column, block_id: Column) -> Column:
    """The paragraph that ends in ``^id``, or the one above a line of ``^id`` alone, without the id; null where there is none. Headings and other ids bound a paragraph."""
    mark = F.concat(F.lit("^"), block_id)

    def cut(ls: Column) -> Column:
        here = F.sequence(F.lit(0), F.size(ls) - 1)
        at = F.get(F.filter(here, lambda i: (strip(F.get(ls, i)) == mark) | F.endswith(strip(F.get(ls, i)), F.concat(F.lit(" "), mark))), F.lit(0))

        def around(i: Column) -> Column:
            lone = strip(F.get(ls, i)) == mark
            last = F.when(lone, F.coalesce(F.array_max(F.filter(here, lambda j: (j < i) & (strip(F.get(ls, j)) != ""))), F.lit(-1))).otherwise(i)

            def para(e: Column) -> Column:
                stop = F.filter(here, lambda j: (j < e) & ((strip(F.get(ls, j)) == "") | F.get(ls, j).rlike(r"^#{1,9}\s") | F.get(ls, j).rlike(r"(^|\s)\^[\w-]+\s*$")))
                first = F.coalesce(F.array_max(stop) + 1, F.lit(0))
                joined = F.array_join(F.slice(ls, first + 1, e - first + 1), "\n")
                return F.when(e >= 0, strip(F.regexp_replace(joined, r"(?<=\s)\^[\w-]+\s*\z", "")))

            return bound(last, para)

        return bound(at, lambda i: F.when(i.isNotNull(), around(i)))

    return bound(text_lines(text), cut)


def smart_join_blocks(blocks: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """``keys, text``: lines joined by one line feed between list items, else by two."""
    piled = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "is_list", "line"))).alias("_v"))

    def piece(v: Column, i: Column) -> Column:
        before = F.get(F.col("_v"), i - 1)
        gap = F.when(i == 0, "").when(v["is_list"] & before["is_list"], "\n").otherwise("\n\n")
        return F.concat(gap, v["line"])

    return piled.select(*keys, F.array_join(F.transform("_v", piece), "").alias("text"))


def list_counters(items: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """``counter`` of each list item (``list_id, level``; null level is no item): from 1 for each list and level, deeper levels begin again below a shallower item, all after other content."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = items.withColumn("_island", F.sum(F.when(F.col("level").isNull(), 1).otherwise(0)).over(w))
    most = 9
    for k in range(most):
        shallower = F.sum(F.when(F.col("level") < k, 1).otherwise(0)).over(Window.partitionBy(*keys, "_island", "list_id").orderBy(order))
        rows = rows.withColumn(f"_r{k}", shallower)
    reset = F.lit(0).cast("bigint")
    for k in range(most):
        reset = F.when(F.col("level") == k, F.col(f"_r{k}")).otherwise(reset)
    rows = rows.withColumn("_reset", reset)
    count = F.row_number().over(Window.partitionBy(*keys, "_island", "list_id", "level", "_reset").orderBy(order))
    return rows.select(*items.columns, F.when(F.col("level").isNotNull(), count).alias("counter"))


BLOCKS = "seq int, type string, level int, text string, language string, attached boolean, list_level int"
# Signs at the end of a heading that let the line below join it; after those of ASCII a blank comes between.
END_MARKS = "。，；：！？、—～….,;:!?–-．؟؛،۔·¿¡։՞՜။၊።፣፧།༎ฯ។៕"
BLANK_AFTER = ".,;:!?"


def _blocks(body: str | None) -> list[tuple]:
    """``seq, type, level, text, language, attached, list_level`` of one body, by a scan over its lines."""
    lines = re.sub(r"\r\n?", "\n", body or "").split("\n")
    out: list[tuple] = []
    indents: list[int] = []  # of the open list's levels
    i = 0

    def put(kind: str, level: int | None, text: str, language: str = "", under: int | None = None) -> None:
        out.append((len(out), kind, level, text, language, attached, under))

    while i < len(lines):
        line = lines[i]
        attached = i > 0 and bool(lines[i - 1].strip())
        i += 1
        if not line.strip():
            continue
        fence = re.match(r"^([ \t]*)(`{3,}|~{3,})\s*([^`\s]*)", line)
        item = re.match(r"^([ \t]*)([-*+]|\d+[.)])\s+(.*)$", line)
        rule = re.match(r"^\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$", line)
        # Code doesn't end a list; what else isn't indented does.
        if (not item or rule) and not fence and line[:1] not in " \t":
            indents = []
        if fence:
            inside, cut = [], len(fence[1].expandtabs(4))
            while i < len(lines) and not re.match(rf"^[ \t]*{re.escape(fence[2][0])}{{{len(fence[2])},}}\s*$", lines[i]):
                text = lines[i].expandtabs(4)
                inside.append(text[min(cut, len(text) - len(text.lstrip())) :])
                i += 1
            i += 1
            around = sum(width <= cut for width in indents) if fence[1] else 0
            put("code", None, "\n".join(inside), fence[3], around or None)
        elif m := re.match(r"^(#{1,9})\s+(.*)$", line):
            put("heading", len(m[1]), m[2].strip())
        elif rule:
            put("hr", None, line.strip()[0])
        elif line.strip().startswith("$$"):
            inside = [line.strip()[2:]]
            while not inside[-1].rstrip().endswith("$$") and i < len(lines):
                inside.append(lines[i])
                i += 1
            put("formula", None, "\n".join(inside).rstrip().removesuffix("$$").strip())
        elif line.lstrip("> \t").startswith("|") and i < len(lines) and re.match(r"^[> \t]*\|(?:[\s:]*-[\s\-:]*\|)+\s*$", lines[i]):
            inside = [line, lines[i]]
            i += 1
            while i < len(lines) and re.match(r"^[> \t]*\|.*\|", lines[i]):
                inside.append(lines[i])
                i += 1
            put("table", None, "\n".join(inside))
        elif m := re.match(r"^((?:>\s?){1,9})(.*)$", line):
            put("quote", m[1].count(">"), m[2].strip())
        elif item:
            width = len(item[1].expandtabs(4))
            while indents and indents[-1] > width:
                indents.pop()
            if not indents or indents[-1] < width:
                indents.append(width)
            put("ordered" if item[2][0].isdigit() else "bullet", len(indents), item[3].strip())
        elif indents and out and out[-1][1] in ("ordered", "bullet"):
            n, kind, level, text, _, above, _ = out.pop()
            out.append((n, kind, level, f"{text}\n{line.strip()}", "", above, None))
        elif i < len(lines) and re.match(r"^(=+|-+)\s*$", lines[i]):
            put("heading", 1 if lines[i][0] == "=" else 2, line.strip())
            i += 1
        else:
            put("paragraph", None, line.strip())
    return out


def segment_blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns and ``seq, type, level, text, language, attached, list_level, has_formula, in_list_context`` of every block: headings (both forms), fenced code, rules, formulas, tables, quotes, list items with relative levels and their continuations, paragraphs.

    ``attached`` is whether no blank line is above; an attached rule belongs to the block before. Indented code within a list is
    ``in_list_context`` and has the ``list_level`` of the item whose indent it reaches. ``has_formula`` is told of formulas, paragraphs, quotes and items.
    What a line is depends on the lines before it, so a document is scanned in one go; no shuffle.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others), BLOCKS])

    def scan(batches):
        for pdf in batches:
            parts = [(*key, *b) for *key, text in pdf[[*others, "_text"]].itertuples(index=False, name=None) for b in _blocks(text)]
            out = pd.DataFrame(parts, columns=[*others, "seq", "type", "level", "text", "language", "attached", "list_level"])
            yield out.astype({"level": "Int32", "list_level": "Int32"})

    formula = (F.col("type") == "formula") | (F.col("type").isin("paragraph", "quote", "bullet", "ordered") & F.col("text").rlike(FORMULA))
    return rows.mapInPandas(scan, schema).withColumn("has_formula", formula).withColumn("in_list_context", F.col("list_level").isNotNull())


def merge_heading_content(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with ``content``: a heading that ends in a sign takes an attached paragraph below it (type ``heading_with_content``), which goes; ``seq`` stays. A shuffle by document."""
    order = Window.partitionBy(*keys).orderBy("seq")
    ends = (F.col("type") == "heading") & F.contains(F.lit(END_MARKS), F.right("text", F.lit(1))) & (F.col("text") != "")
    rows = blocks.withColumn("_ends", ends).withColumn("_joins", F.lag("_ends").over(order) & (F.col("type") == "paragraph") & F.col("attached"))
    rows = rows.withColumn("_next", F.lead(F.when(F.col("_joins"), F.col("text"))).over(order)).filter(~F.coalesce("_joins", F.lit(False)))
    merged = F.col("_ends") & F.col("_next").isNotNull()
    content = F.when(merged, F.concat(F.when(F.right("text", F.lit(1)).isin(*BLANK_AFTER), " ").otherwise(""), "_next"))
    return rows.select(*(F.when(merged, "heading_with_content").otherwise(F.col("type")).alias("type") if c == "type" else F.col(c) for c in blocks.columns), content.alias("content"))
