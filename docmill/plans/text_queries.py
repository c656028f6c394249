"""Text cleaning and scalar functions over texts that are composed from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as X
from docmill.plans.common import Queries, table

query = Queries()
QUERIES, ORACLES = query.QUERIES, query.ORACLES


def _clean_sql(x: str) -> str:
    x = f"regexp_replace(regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')"
    for e, c in X.ENTITIES.items():
        x = f"replace({x}, '{e}', '{c.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace(translate({x}, '{X.ZERO_WIDTH}', ''), '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"


@query(f"SELECT page_id, {_clean_sql('html')} AS clean, 'é中😀x' AS decoded FROM pages")
def T1_clean_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", X.clean_text(F.col("html")).alias("clean"), X.clean_text(F.concat(F.lit("&#233;&#x4E2D;&#128512;x"), F.substring("html", 1, 0))).alias("decoded"))


@query(f"SELECT page_id, {_clean_sql('html')} AS body, url AS first, {_clean_sql('html')} AS second FROM pages")
def T2_clean_nested(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.struct(F.col("html").alias("body"), F.array("url", "html").alias("more")).alias("x"))
    return rows.select("page_id", X.clean_nested(F.col("x"), rows.schema["x"].dataType).alias("x")).select("page_id", "x.body", F.col("x.more")[0].alias("first"), F.col("x.more")[1].alias("second"))


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS text_empty, p_partkey % 2 = 0 AS list_empty FROM part")
def T3_is_value_empty(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k, F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.lit(" \t　")).alias("t"), F.when(k % 2 == 0, F.array(F.lit(" "), F.lit(None))).otherwise(F.array(F.lit(""), F.col("p_name"))).alias("l")
    )
    return rows.select(k, X.is_value_empty(F.col("t"), T.StringType()).alias("text_empty"), X.is_value_empty(F.col("l"), T.ArrayType(T.StringType())).alias("list_empty"))


@query("SELECT c_custkey, c_name || '、' || c_mktsegment AS shown, 2 AS listed, [c_name, c_mktsegment] AS parsed FROM customer")
def T4_format_display_value(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    nested = F.array(F.array(F.concat(F.lit(" "), F.col("c_name")), F.lit("None")), F.array(F.lit(" "), F.col("c_mktsegment"), F.lit("null")))
    literal = F.concat(F.lit("['"), F.col("c_name"), F.lit("', \""), F.col("c_mktsegment"), F.lit('"]'))
    return rows.select("c_custkey", X.format_display_value(nested).alias("shown"), F.size(X.process_list_field(F.flatten(nested))).alias("listed"), X.parse_list_literal(literal).alias("parsed"))


def _order_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", d, F.year(d).cast("string").alias("y"), F.month(d).cast("string").alias("m"), F.day(d).cast("string").alias("d"), (F.col("o_orderkey") % 5).alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'on ' || year(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS normal FROM orders")
def T5_normalize_date(spark, sf_dir):
    rows, k = _order_dates(spark, sf_dir), F.col("k")
    y, m, d = "y", "m", "d"
    raw = (
        F.when(k == 0, F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日")))
        .when(k == 1, F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("号 and on")))
        .when(k == 2, F.concat_ws("-", y, m, d))
        .when(k == 3, F.concat_ws(".", y, m, d))
        .otherwise(F.concat(F.lit("on "), y))
    )
    return rows.select("o_orderkey", X.normalize_date(raw).alias("normal"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN year(o_orderdate) || '/13/40' ELSE year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日印发' END AS shown FROM orders")
def T6_format_cn_date(spark, sf_dir):
    rows, k = _order_dates(spark, sf_dir), F.col("k")
    raw = (
        F.when(k == 0, F.concat_ws("-", "y", "m", "d"))
        .when(k == 1, F.concat_ws("/", "y", F.lpad("m", 2, "0"), "d"))
        .when(k == 2, F.concat("y", F.lpad("m", 2, "0"), F.lpad("d", 2, "0")))
        .when(k == 3, F.concat_ws(".", "y", "m", "d"))
        .otherwise(F.concat("y", F.lit("/13/40")))
    )
    return rows.select("o_orderkey", X.format_cn_date(raw, "印发").alias("shown"))


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 2) AS valid FROM orders")
def T7_is_valid_date_text(spark, sf_dir):
    rows, k = _order_dates(spark, sf_dir), F.col("k")
    mm, dd = F.lpad("m", 2, "0"), F.lpad("d", 2, "0")
    raw = (
        F.when(k == 0, F.concat("y", F.lit("年"), F.col("m"), F.lit("月"), F.col("d"), F.lit("日")))
        .when(k == 1, F.concat_ws("-", "y", mm, dd))
        .when(k == 2, F.concat_ws("/", "y", mm, dd))
        .when(k == 3, F.concat_ws("-", "y", mm))
        .otherwise(F.concat("y", mm, dd))
    )
    return rows.select("o_orderkey", X.is_valid_date_text(raw).alias("valid"))


_TENS = ["", "十", "二十", "三十", "四十", "五十", "六十", "七十", "八十", "九十"]
_ROMAN = (["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC", "C"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])


def _styles_sql() -> str:
    rows = []
    for n in range(106):
        cn = "" if n == 0 else str(n) if n > 99 else _TENS[n // 10] + " 一二三四五六七八九"[n % 10].strip()
        up = cn.translate(str.maketrans("一二三四五六七八九十", "壹贰叁肆伍陆柒捌玖拾"))
        circled = "" if n == 0 else chr(0x245F + n) if n <= 20 else chr(0x3251 + n - 21) if n <= 35 else chr(0x32B1 + n - 36) if n <= 50 else str(n)
        letters = "" if n == 0 else chr(64 + n) if n <= 26 else chr(64 + (n - 1) // 26) + chr(65 + (n - 1) % 26)
        roman = _ROMAN[0][n // 10] + _ROMAN[1][n % 10]
        full = "".join(chr(0xFF10 + int(c)) for c in str(n))
        rows.append(f"({n}, '{cn}', '{up}', '{n}', '{full}', '{circled}', '{letters}', '{letters.lower()}', '{roman}', '{roman.lower()}')")
    return f"SELECT p_partkey, {', '.join(X.STYLES)} FROM part JOIN (VALUES {', '.join(rows)}) AS v(n, {', '.join(X.STYLES)}) ON p_partkey % 106 = n"


@query(_styles_sql())
def T8_number_style(spark, sf_dir):
    n = (F.col("p_partkey") % 106).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", *(X.number_style(n, s).alias(s) for s in X.STYLES))


@query("SELECT c_custkey, c_name AS half FROM customer")
def T9_to_halfwidth_digits(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.to_halfwidth_digits(F.translate("c_name", "0123456789", "０１２３４５６７８９")).alias("half"))


@query("SELECT doc_id, doc_id % 3 = 0 AS chinese, doc_id % 3 < 2 AS east_asian FROM documents")
def T10_script_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    x = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "中").when(F.col("doc_id") % 3 == 1, "カ").otherwise(""))
    return docs.select("doc_id", X.has_chinese(x).alias("chinese"), X.has_east_asian(x).alias("east_asian"))


@query(
    "SELECT l_orderkey, l_linenumber, l_orderkey % 5 IN (0, 1, 2) AS pure, l_orderkey % 5 = 2 AS fraction, l_orderkey % 5 IN (0, 1) AS numeric, "
    "CASE l_orderkey % 5 WHEN 0 THEN l_quantity WHEN 1 THEN -l_linenumber / 2.0 END::DOUBLE AS number FROM lineitem"
)
def T11_number_tests(spark, sf_dir):
    k = F.col("l_orderkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
        .when(k == 1, F.concat(F.lit("-"), (F.col("l_linenumber") / 2).cast("string")))
        .when(k == 2, F.concat(F.col("l_linenumber").cast("string"), F.lit("/7")))
        .when(k == 3, F.concat(F.col("l_linenumber").cast("string"), F.lit("d")))
        .otherwise(F.lit("1.2.3"))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", X.is_pure_number(raw).alias("pure"), X.is_fraction(raw).alias("fraction"), X.is_numeric_string(raw).alias("numeric"), X.to_number(raw).alias("number")
    )


@query("SELECT c_custkey, c_name AS no_colon, c_name AS after, c_name AS bare, [c_name, 'B', 'C'] AS copies, c_name AS attachment FROM customer")
def T12_colon_bracket_ops(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        X.remove_colon(F.concat(n, F.lit("："))).alias("no_colon"),
        X.after_colon(F.concat(F.lit("to:  "), n, F.lit(" "))).alias("after"),
        X.remove_brackets(F.concat(F.lit("（"), n, F.lit(")"))).alias("bare"),
        X.split_copy_to(F.concat(F.lit("抄送： "), n, F.lit("， B、 ,C。"))).alias("copies"),
        X.attachment_name(F.concat(F.lit("附件：12. "), n, F.lit("。"))).alias("attachment"),
    )


@query("SELECT c_custkey, c_name || CASE c_custkey % 3 WHEN 0 THEN '：' WHEN 1 THEN '。a' || c_name || '：' ELSE '' END AS title, CASE c_custkey % 3 WHEN 2 THEN '' ELSE 'rest.' END AS body FROM customer")
def T13_split_on_terminator(spark, sf_dir):
    n, k = F.col("c_name"), F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(n, F.lit("： rest."))).when(k == 1, F.concat(n, F.lit("。a"), n, F.lit("：rest."))).otherwise(n)
    return table(spark, sf_dir, "customer").select("c_custkey", X.split_on_terminator(raw).alias("s")).select("c_custkey", "s.title", "s.body")


@query("SELECT p_partkey, p_name || ' and *' || p_brand || '* by ' || p_type || ' ' || p_name || '2' AS plain FROM part")
def T14_strip_inline_marks(spark, sf_dir):
    raw = F.concat(F.lit("**"), "p_name", F.lit("** and `*"), "p_brand", F.lit("*` by ~~"), "p_type", F.lit("~~ =="), "p_name", F.lit("==<sup>2</sup>"))
    return table(spark, sf_dir, "part").select("p_partkey", X.strip_inline_marks(raw).alias("plain"))


@query("SELECT p_partkey, 'a |' || p_name || ' |' || p_type || '|*' || p_brand || '*| z' AS texts, '|bold|bold,underline|code|' AS formats FROM part")
def T15_inline_spans(spark, sf_dir):
    raw = F.concat(F.lit("a **"), "p_name", F.lit(" <u>"), "p_type", F.lit("</u>**`*"), "p_brand", F.lit("*` z"))
    rows = table(spark, sf_dir, "part").select("p_partkey", X.inline_spans(raw).alias("s"))
    shown = F.array_join(F.transform("s", lambda s: F.array_join(s["formats"], ",")), "|")
    return rows.select("p_partkey", F.array_join(F.transform("s", lambda s: s["text"]), "|").alias("texts"), shown.alias("formats"))


@query("SELECT page_id, '[[' || url || ']]' AS wiki, '![[' || url || ']]' AS wiki_embed, '[' || url || '](' || url || ')' AS markdown, '![' || url || '](' || url || ')' AS markdown_embed, '[' || url || '](' || url || ')' AS document FROM pages")
def T16_format_link(spark, sf_dir):
    styles = ("wiki", "wiki_embed", "markdown", "markdown_embed")
    return table(spark, sf_dir, "pages").select("page_id", *(X.format_link(F.col("url"), s, True).alias(s) for s in styles), X.format_link(F.col("url"), "markdown_embed", False).alias("document"))


@query("SELECT page_id, '![' || url || '](data:image/png;base64,' || base64(encode(html)) || ')' AS markdown_embed, '[[data:image/png;base64,' || base64(encode(html)) || ']]' AS wiki FROM pages")
def T16_format_base64_link(spark, sf_dir):
    link = lambda style: X.format_base64_link(F.encode("html", "UTF-8"), F.lit("image/png"), F.col("url"), style).alias(style)
    return table(spark, sf_dir, "pages").select("page_id", link("markdown_embed"), link("wiki"))


@query("SELECT p_partkey, p_name AS path, p_size AS width, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::INTEGER ELSE -1 END AS height FROM part")
def T17_parse_image_payload(spark, sf_dir):
    raw = F.concat("p_name", F.lit("|"), "p_size", F.lit(" |"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("x"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey"), X.parse_image_payload(raw).alias("s")).select("p_partkey", "s.path", "s.width", F.coalesce("s.height", F.lit(-1)).alias("height"))
