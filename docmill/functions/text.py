"""Text cleaning and scalar functions: Column in, Column out, usable on streams.

A null input gives a null result unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python's str.strip sees it, named entities, zero-width characters.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
ENTITIES = {
    "&nbsp;": " ", "&ensp;": " ", "&emsp;": "　", "&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&mdash;": "—", "&ndash;": "–",
    "&hellip;": "…", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&times;": "×", "&divide;": "÷", "&middot;": "·", "&bull;": "•", "&laquo;": "«", "&raquo;": "»",
}
ZERO_WIDTH = "​‌‍﻿⁠"


def strip(x: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.btrim(x, F.lit(SPACES))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Elements of a block of :func:`scan`.
BLOCK = 256


def scan(xs: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states (of SQL type ``kind``) after each element of an array, from ``start`` by ``step(state, element)``.

    States gather in blocks, as an array that grows by one element at a time would be copied for each of them.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        return bound(step(acc["now"], x), lambda n: F.struct(n.alias("now"), F.concat(acc["all"], F.array(n)).alias("all")))

    def block(values: Column):
        def run(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(values, (k * BLOCK + 1).cast("int"), F.lit(BLOCK)), F.struct(acc["now"].alias("now"), none.alias("all")), one)
            return bound(part, lambda p: F.struct(p["now"].alias("now"), F.concat(acc["all"], F.array(p["all"])).alias("all")))

        return run

    def scanned(values: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK).cast("int"), F.lit(0)))
        return F.aggregate(blocks, F.struct(start.cast(kind).alias("now"), nones.alias("all")), block(values), lambda acc: F.flatten(acc["all"]))

    return bound(xs, scanned)


def owned(flags: Column) -> Column:
    """From an array of booleans (``this line belongs to the one above``): ``at`` and ``until`` of every line that doesn't, with all that follow it."""

    def cut(on: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(on) - 1), lambda i: ~F.get(on, i) | (i == 0))
        return bound(heads, lambda hs: F.transform(hs, lambda h, k: F.struct(h.alias("at"), F.coalesce(F.get(hs, k + 1), F.size(on)).alias("until"))))

    return bound(flags, cut)


def wide(x: Column) -> Column:
    """A text in UTF-32, of which :func:`piece` takes slices in time of their own size, wherever they lie."""
    return F.encode(x, "UTF-32")


def piece(w: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` (0-based) of a :func:`wide` text; a mark in front keeps one of the text's own from being taken for it."""
    return F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), F.substring(w, 4 * start + 1, 4 * size)), "UTF-32")


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numeric_entities(x: Column, entity: str, digits: str, base: int) -> Column:
    """Replace numeric entities; the text between them is kept piece by piece."""
    pieces = F.split(x, rf"(?={entity})|(?<=;)", -1)

    def decoded(p: Column) -> Column:
        n = F.conv(F.regexp_extract(p, digits, 1), base, 10).cast("bigint")
        known = p.rlike(rf"\A{entity}\z") & (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(known, _code_point(n)).otherwise(p)

    return F.when(x.rlike(entity), F.array_join(F.transform(pieces, decoded), "")).otherwise(x)


def clean_text(x: Column) -> Column:
    """Line breaks for ``<br>``; comments, tags, zero-width and control characters go; entities become characters."""
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    for entity, char in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = _numeric_entities(x, r"&#\d{1,7};", r"(\d+)", 10)
    x = _numeric_entities(x, r"&#[xX][0-9a-fA-F]{1,6};", r"[xX]([0-9a-fA-F]+)", 16)
    x = F.translate(x, ZERO_WIDTH, "")
    return F.regexp_replace(x, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "")


def clean_nested(x: Column, kind: T.DataType) -> Column:
    """:func:`clean_text` on every string inside arrays, maps' values and structs."""
    if isinstance(kind, T.StringType):
        return clean_text(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: clean_nested(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda k, v: clean_nested(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(clean_nested(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return x


def is_value_empty(x: Column, kind: T.DataType) -> Column:
    """Null, blank, or a container of nothing but empty values; never null."""
    if isinstance(kind, T.StringType):
        return F.coalesce(strip(x) == "", F.lit(True))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(x, lambda e: is_value_empty(e, kind.elementType)), F.lit(True))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.forall(F.map_values(x), lambda e: is_value_empty(e, kind.valueType)), F.lit(True))
    return x.isNull()


def process_list_field(x: Column) -> Column:
    """Array of strings without blank, ``null`` and ``None`` entries, each stripped."""
    return F.filter(F.transform(x, strip), lambda e: e.isNotNull() & (e != "") & ~F.lower(e).isin("null", "none"))


def format_display_value(x: Column, separator: str = "、") -> Column:
    """Array of arrays of strings as one text."""
    return F.array_join(process_list_field(F.flatten(x)), separator)


def parse_list_literal(x: Column) -> Column:
    """A text like ``['a', "b"]`` as array; any other text as array of itself."""
    looks = x.rlike(r"(?s)\A\s*\[.*\]\s*\z")
    parsed = F.from_json(F.replace(x, F.lit("'"), F.lit('"')), "array<string>")
    return F.when(looks & parsed.isNotNull(), parsed).otherwise(F.array(x))


def normalize_date(x: Column) -> Column:
    """``YYYY-MM-DD`` from a leading date; other texts unchanged."""
    out = []
    for a, b, c in (("年", "月", "[日号]"), ("-", "-", ""), (r"\.", r"\.", "")):
        p = rf"\A(\d{{4}}){a}(\d{{1,2}}){b}(\d{{1,2}}){c}"
        out.append(F.when(x.rlike(p), F.concat_ws("-", F.regexp_extract(x, p, 1), F.lpad(F.regexp_extract(x, p, 2), 2, "0"), F.lpad(F.regexp_extract(x, p, 3), 2, "0"))))
    return F.coalesce(*out, x)


CN_DATE_FORMATS = (r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})/(\d{1,2})/(\d{1,2})", r"(\d{4})\.(\d{1,2})\.(\d{1,2})", r"(\d{4})(\d{2})(\d{2})")


def format_cn_date(x: Column, suffix: str = "") -> Column:
    """``YYYY年M月D日`` and suffix from one of five whole formats of a real date; other texts unchanged."""
    out = []
    for p in CN_DATE_FORMATS:
        y, m, d = (F.regexp_extract(x, rf"\A{p}\z", k) for k in (1, 2, 3))
        real = F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).isNotNull()
        out.append(F.when(x.rlike(rf"\A{p}\z") & real, F.concat(y, F.lit("年"), m.cast("int").cast("string"), F.lit("月"), d.cast("int").cast("string"), F.lit("日" + suffix))))
    return F.coalesce(*out, x)


def is_valid_date_text(x: Column) -> Column:
    return x.rlike(r"\A(\d{4}年\d{1,2}月\d{1,2}日|\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2})\n?\z")


# Digits of the numbering styles.
CN_LOWER, CN_UPPER = ("一二三四五六七八九", "十"), ("壹贰叁肆伍陆柒捌玖", "拾")
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def _chinese(n: Column, digits: str, ten: str) -> Column:
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    head = F.when(tens > 1, F.substring(F.lit(digits), tens, F.lit(1))).otherwise("")
    return F.when(n <= 0, "").when(n >= 100, n.cast("string")).otherwise(
        F.concat(head, F.when(tens >= 1, ten).otherwise(""), F.when(ones > 0, F.substring(F.lit(digits), ones, F.lit(1))).otherwise(""))
    )


def _letters(n: Column) -> Column:
    """A to Z, AA and on; up to four letters."""
    out, rest = F.lit(""), n.cast("bigint")
    for _ in range(4):
        digit = F.pmod(rest - 1, F.lit(26)).cast("int")
        out = F.when(rest > 0, F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), digit + 1, F.lit(1)), out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(0)
    return out


def _roman(n: Column) -> Column:
    parts, rest = [], n.cast("bigint")
    for value, sign in ROMAN:
        parts.append(F.repeat(F.lit(sign), F.greatest(F.floor(rest / value), F.lit(0)).cast("int")))
        rest = rest % value
    return F.when((n >= 1) & (n <= 3999), F.concat(*parts)).otherwise(n.cast("string"))


def _circled(n: Column) -> Column:
    code = F.when(n.between(1, 20), n + 0x245F).when(n.between(21, 35), n + (0x3251 - 21)).when(n.between(36, 50), n + (0x32B1 - 36))
    return F.when(code.isNotNull(), _code_point(code.cast("bigint"))).when(n <= 0, "").otherwise(n.cast("string"))


def number_style(n: Column, style: str) -> Column:
    """A number in a numbering style; numbers beyond a style's range stay Arabic."""
    if style == "chinese_lower":
        return _chinese(n, *CN_LOWER)
    if style == "chinese_upper":
        return _chinese(n, *CN_UPPER)
    if style == "arabic_half":
        return n.cast("string")
    if style == "arabic_full":
        return F.translate(n.cast("string"), "0123456789", "０１２３４５６７８９")
    if style == "arabic_circled":
        return _circled(n)
    if style in ("letter_upper", "letter_lower"):
        out = F.when(n <= 0, "").otherwise(_letters(n))
        return out if style == "letter_upper" else F.lower(out)
    if style in ("roman_upper", "roman_lower"):
        out = F.when(n <= 0, "").otherwise(_roman(n))
        return out if style == "roman_upper" else F.lower(out)
    raise ValueError(f"unknown style {style}")


STYLES = ("chinese_lower", "chinese_upper", "arabic_half", "arabic_full", "arabic_circled", "letter_upper", "letter_lower", "roman_upper", "roman_lower")


def to_halfwidth_digits(x: Column) -> Column:
    return F.translate(x, "０１２３４５６７８９", "0123456789")


def has_chinese(x: Column) -> Column:
    return x.rlike(r"[\x{4E00}-\x{9FFF}]")


def has_east_asian(x: Column) -> Column:
    return x.rlike(r"[\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}“”‘’…—―]")


NUMBER = r"[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?"


def is_fraction(x: Column) -> Column:
    return F.coalesce(strip(x).rlike(r"\A-?\d+/\d+\z"), F.lit(False))


def is_numeric_string(x: Column) -> Column:
    return F.coalesce(strip(x).rlike(rf"\A{NUMBER}\z"), F.lit(False))


def is_pure_number(x: Column) -> Column:
    return is_fraction(x) | is_numeric_string(x)


def to_number(x: Column) -> Column:
    """The double that a numeric text means, else null."""
    return F.when(is_numeric_string(x), F.replace(strip(x), F.lit("_"), F.lit("")).try_cast("double"))


def remove_colon(x: Column) -> Column:
    return F.regexp_replace(x, r"[：:]$", "")


def after_colon(x: Column) -> Column:
    """What follows the first colon, stripped; the whole text where there is none."""
    return F.when(x.rlike("[：:]"), strip(F.element_at(F.split(x, "[：:]", 2), 2))).otherwise(x)


def remove_brackets(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^[（(]", ""), r"[)）]$", "")


def split_copy_to(x: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(x, r"^抄送[：:.]\s*", ""), r"[。.]$", "")
    return F.filter(F.transform(F.split(body, "[，,、]", -1), strip), lambda e: e != "")


def attachment_name(x: Column) -> Column:
    x = F.regexp_replace(x, r"^附件[：:]\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(x, r"^\d+[\.．]\s*", ""), r"[。.]$", ""))


TERMINATORS = ("：", ":", "。", ".", "．", "！", "!")


def split_on_terminator(x: Column) -> Column:
    """``title`` up to and with the first terminator that occurs, in the order tried, and ``body`` after it."""
    at = F.coalesce(*(F.when(F.locate(d, x) > 0, F.locate(d, x)) for d in TERMINATORS), F.lit(0))
    return F.when(at > 0, F.struct(F.substring(x, F.lit(1), at).alias("title"), strip(F.substring(x, at + 1, F.char_length(x))).alias("body"))).otherwise(
        F.struct(x.alias("title"), F.lit("").alias("body"))
    )


# Emphasis marks and the formats that they mean; the first of equally long marks at a place counts.
MARKS = (
    (r"\*\*\*(.+?)\*\*\*", "bold_italic"), (r"___(.+?)___", "bold_italic"), (r"\*\*(.+?)\*\*", "bold"), (r"__(.+?)__", "bold"), (r"~~(.+?)~~", "strikethrough"), (r"(?i)<del>(.+?)</del>", "strikethrough"),
    (r"==(.+?)==", "highlight"), (r"(?i)<mark>(.+?)</mark>", "highlight"), (r"\^([^\^]+?)\^", "superscript"), (r"(?i)<sup>(.+?)</sup>", "superscript"), (r"(?<!~)~([^~]+?)~(?!~)", "subscript"), (r"(?i)<sub>(.+?)</sub>", "subscript"),
    (r"(?i)<u>(.+?)</u>", "underline"), (r"\*(.+?)\*", "italic"), (r"(?<!\w)_([^_]+?)_(?!\w)", "italic"),
)


def strip_inline_marks(x: Column) -> Column:
    """Without emphasis marks; code spans lose their backquotes only.

    Between backquotes, from the left, every other piece of a run of non-empty ones is code; what is closed by no backquote isn't.
    """

    def plain(p: Column) -> Column:
        for mark, _ in MARKS:
            p = F.regexp_replace(p, "(?U)" + mark, "$1")
        return p

    def shown(parts: Column) -> Column:
        filled = F.transform(parts, lambda p, k: (p != "") & (k > 0) & (k < F.size(parts) - 1))

        def joined(code: Column) -> Column:
            goes_on = F.transform(code, lambda c, k: (k > 0) & ~c & ~F.coalesce(F.get(code, k - 1), F.lit(False)))
            texts = F.transform(owned(goes_on), lambda r: F.when(F.get(code, r["at"]), F.get(parts, r["at"])).otherwise(plain(F.array_join(F.slice(parts, r["at"] + 1, r["until"] - r["at"]), "`"))))
            return F.array_join(texts, "")

        return bound(scan(filled, F.lit(False), lambda before, own: own & ~before, "boolean"), joined)

    return F.when(F.contains(x, F.lit("`")), bound(F.split(x, "`", -1), shown)).otherwise(plain(x))


def format_link(name: Column, style: str, image: bool) -> Column:
    """A file name as one of four link styles; an embed has ``!`` in front. Markdown can't embed documents, so only images get an embed there."""
    return _link(name, name, style, image)


def format_base64_link(content: Column, mime_type: Column, alt: Column, style: str) -> Column:
    """An image's bytes as a link to its data URI; Markdown styles have the alternative text as label. Null where anything is null."""
    return _link(alt, F.concat(F.lit("data:"), mime_type, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))), style, True)


def _link(label: Column, target: Column, style: str, image: bool) -> Column:
    if style not in ("wiki", "wiki_embed", "markdown", "markdown_embed"):
        raise ValueError(f"unknown style {style}")
    wiki = style.startswith("wiki")
    bang = "!" if style.endswith("_embed") and (wiki or image) else ""
    if wiki:
        return F.concat(F.lit(bang + "[["), target, F.lit("]]"))
    return F.concat(F.lit(bang + "["), label, F.lit("]("), target, F.lit(")"))


def parse_image_payload(x: Column) -> Column:
    """``path|width|height`` as struct; sizes that are no numbers are null."""
    parts = F.split(x, r"\|", -1)

    def size(k: int) -> Column:
        s = strip(F.get(parts, F.lit(k)))
        return F.when(s.rlike(r"\A\d{1,9}\z"), s.cast("int"))

    return F.struct(strip(F.get(parts, F.lit(0))).alias("path"), size(1).alias("width"), size(2).alias("height"))


def _inline(text: str, formats: tuple[str, ...], marks: list) -> list[tuple[str, list[str]]]:
    """Segments of a text without code: the mark that begins first, of those the longest, then what is inside and behind it."""
    out = []
    while text:
        found = [(m.start(), m.start() - m.end(), k, m) for k, (p, _) in enumerate(marks) if (m := p.search(text))]
        if not found:
            out.append((text, list(formats)))
            break
        *_, k, m = min(found, key=lambda f: f[:3])
        if m.start():
            out.append((text[: m.start()], list(formats)))
        out += _inline(m[1], (*formats, marks[k][1]), marks)
        text = text[m.end() :]
    return out


def inline_spans(x: Column) -> Column:
    """Array of ``text`` and ``formats`` in order: code spans first, then marks, nested ones with all their formats. A pandas UDF; null gives an empty array."""

    def spans(texts: pd.Series) -> pd.Series:
        marks = [(re.compile(p), f) for p, f in MARKS]

        def one(t: str | None) -> list[dict]:
            out = []
            for k, part in enumerate(re.split(r"`([^`]+)`", t or "")):
                if part:
                    out += [(part, ["code"])] if k % 2 else _inline(part, (), marks)
            return [{"text": a, "formats": b} for a, b in out]

        return texts.map(one)

    return F.pandas_udf(spans, "array<struct<text:string,formats:array<string>>>")(x)
