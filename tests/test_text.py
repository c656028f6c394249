import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a<br/>b<BR >c", "a\nb\nc"), ("x<!-- a\nb -->y<p class='q'>z</p>", "xyz"), ("&nbsp;&lt;&amp;&#65;&#x1F600;&#233;", " <&A😀é"), ("a​b﻿\x07\tc\n", "ab\tc\n"), ("&#99999999;", "&#99999999;"), (None, None), ("", ""),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, X.clean_text) == want


def test_clean_nested(spark):
    df = spark.createDataFrame([(("<b>x</b>", ["a<i>"], {"k": "&lt;"}),)], "x struct<s:string,a:array<string>,m:map<string,string>>")
    y = df.select(X.clean_nested(F.col("x"), df.schema["x"].dataType).alias("y")).first().y
    assert (y.s, y.a, y.m) == ("x", ["a"], {"k": "<"})


@pytest.mark.parametrize(
    ("n", "style", "want"),
    [
        (12, "chinese_lower", "十二"), (20, "chinese_lower", "二十"), (99, "chinese_upper", "玖拾玖"), (100, "chinese_lower", "100"), (0, "chinese_lower", ""), (7, "arabic_full", "７"), (20, "arabic_circled", "⑳"), (21, "arabic_circled", "㉑"),
        (50, "arabic_circled", "㊿"), (51, "arabic_circled", "51"), (27, "letter_upper", "AA"), (703, "letter_lower", "aaa"), (3999, "roman_upper", "MMMCMXCIX"), (4000, "roman_upper", "4000"),
    ],
)
def test_number_style(spark, n, style, want):
    assert one(spark, n, lambda x: X.number_style(x, style), "int") == want


@pytest.mark.parametrize(
    ("raw", "want"), [("2024年3月5日", "2024-03-05"), ("2024年3月5号x", "2024-03-05"), ("2024-3-5", "2024-03-05"), ("2024.12.31", "2024-12-31"), ("on 2024-3-5", "on 2024-3-5"), (None, None)]
)
def test_normalize_date(spark, raw, want):
    assert one(spark, raw, X.normalize_date) == want


@pytest.mark.parametrize(("raw", "want"), [("2025-01-06", "2025年1月6日印发"), ("20250106", "2025年1月6日印发"), ("2025-13-06", "2025-13-06"), ("soon", "soon")])
def test_format_cn_date(spark, raw, want):
    assert one(spark, raw, lambda x: X.format_cn_date(x, "印发")) == want


def test_empty_values(spark):
    assert one(spark, " 　\n", lambda x: X.is_value_empty(x, T.StringType())) is True
    assert one(spark, None, lambda x: X.is_value_empty(x, T.StringType())) is True
    assert one(spark, [" ", "x"], lambda x: X.is_value_empty(x, T.ArrayType(T.StringType())), "array<string>") is False


@pytest.mark.parametrize(("raw", "want"), [("1", 1.0), (" -2.50 ", -2.5), ("1_0", 10.0), ("1d", None), ("1.2.3", None), ("1e3", 1000.0), ("", None), (None, None)])
def test_to_number(spark, raw, want):
    assert one(spark, raw, X.to_number) == want


@pytest.mark.parametrize(("raw", "want"), [("**a** *b* `**c**` ~~d~~", "a b **c** d"), ("plain_text_here", "plain_text_here"), ("==x== H<sub>2</sub>O", "x H2O")])
def test_strip_inline_marks(spark, raw, want):
    assert one(spark, raw, X.strip_inline_marks) == want
