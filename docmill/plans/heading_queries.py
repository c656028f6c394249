"""Heading queries over Markdown composed from ``part``: a document for each brand, a heading for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import headings as H
from docmill.plans.common import Queries, table

query = Queries()
QUERIES, ORACLES = query.QUERIES, query.ORACLES

LEVEL = "(1 + p_size % 4)"


def md_parts(spark, sf_dir):
    """Every fifth part's heading has an old number; every seventh stands in a fence."""
    parts = table(spark, sf_dir, "part").withColumn("level", F.expr(LEVEL))
    old = (
        F.when(F.col("p_partkey") % 5 == 0, "一、")
        .when(F.col("p_partkey") % 5 == 1, "（二） ")
        .when(F.col("p_partkey") % 5 == 2, "3.1.2 ")
        .when(F.col("p_partkey") % 5 == 3, "第四章　")
        .otherwise("")
    )
    line = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), old, F.col("p_name"))
    line = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("```\n"), line, F.lit("\n```"))).otherwise(line)
    lines = parts.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", F.concat(line, F.lit("\nbody "), F.col("p_type")).alias("l")))).alias("ls"))
    return lines.select("p_brand", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("text"))


HEADS = f"""h AS (
  SELECT p_brand, p_partkey, p_name, p_type, {LEVEL}::INTEGER AS level, CASE p_partkey % 5 WHEN 0 THEN '一、' WHEN 1 THEN '（二） ' WHEN 2 THEN '3.1.2 ' WHEN 3 THEN '第四章　' ELSE '' END AS old, p_partkey % 7 = 0 AS fenced FROM part
), l AS (
  SELECT *, (sum(CASE WHEN fenced THEN 4 ELSE 2 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) - CASE WHEN fenced THEN 4 ELSE 2 END)::INTEGER AS line_no FROM h
)"""


@query(f"WITH {HEADS} SELECT p_brand, line_no, level, old || p_name AS heading FROM l WHERE NOT fenced")
def H1_heading_lines(spark, sf_dir):
    return H.heading_lines(md_parts(spark, sf_dir))


@query("SELECT p_partkey, p_name AS bare FROM part")
def H2_remove_numbering(spark, sf_dir):
    k = F.col("p_partkey") % 8
    old = (
        F.when(k == 0, "第一百零一条 ").when(k == 1, "卷 一 ").when(k == 2, "②.").when(k == 3, "（十一）、").when(k == 4, "1.2.3. ").when(k == 5, "壹、").when(k == 6, "１２. ").otherwise(" ")
    )
    return table(spark, sf_dir, "part").select("p_partkey", H.remove_numbering(F.concat(old, "p_name")).alias("bare"))


def _numbered_sql(title: str) -> str:
    reset = ", ".join(f"sum(CASE WHEN level < {k} THEN 1 ELSE 0 END) OVER w AS r{k}" for k in range(1, 5))
    count = ", ".join(f"sum(CASE WHEN level = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand, r{k} ORDER BY p_partkey) AS c{k}" for k in range(1, 5))
    number = " ".join(f"WHEN {k} THEN " + " || '.' || ".join(f"greatest(c{j}, 1)::BIGINT" for j in range(1, k + 1)) + " || ' '" for k in range(1, 5))
    return f"""WITH {HEADS}, a AS (SELECT *, {reset} FROM l WHERE NOT fenced WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)), b AS (SELECT *, {count} FROM a),
lines AS (
  SELECT p_brand, p_partkey, repeat('#', level) || ' ' || CASE level {number} END || {title} || chr(10) || 'body ' || p_type AS x FROM b
  UNION ALL SELECT p_brand, p_partkey, '```' || chr(10) || repeat('#', level) || ' ' || old || p_name || chr(10) || '```' || chr(10) || 'body ' || p_type FROM l WHERE fenced)
SELECT p_brand, string_agg(x, chr(10) ORDER BY p_partkey) AS text FROM lines GROUP BY p_brand"""


@query(_numbered_sql("old || p_name"))
def H3_add_numbering(spark, sf_dir):
    return H.add_numbering(md_parts(spark, sf_dir), "hierarchical_standard")


@query(_numbered_sql("p_name"))
def H4_normalize_numbering(spark, sf_dir):
    return H.normalize_numbering(md_parts(spark, sf_dir), "hierarchical_standard")


@query("SELECT p_partkey, p_name AS clean, (p_partkey % 6)::INTEGER AS level FROM part")
def H5_detect_heading_level(spark, sf_dir):
    k = F.col("p_partkey") % 6
    old = F.when(k == 1, "十二、").when(k == 2, "（三）").when(k == 3, "7. ").when(k == 4, "(12) ").when(k == 5, "⑨").otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", H.detect_heading_level(F.concat(old, "p_name")).alias("d")).select("p_partkey", "d.*")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS level, CASE p_partkey % 3 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '## ' || p_name END AS heading, CASE p_partkey % 3 WHEN 2 THEN p_name || '。' || p_type ELSE p_type END AS body FROM part")
def H6_heading_from_paragraph(spark, sf_dir):
    k = F.col("p_partkey") % 3
    x = F.concat(F.when(k == 0, "一、").otherwise(""), F.col("p_name"), F.lit("。"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", H.heading_from_paragraph(x, F.when(k == 1, 2)).alias("h")).select("p_partkey", "h.*")


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber AS para_no, min(l_partkey) AS p, CASE WHEN l_linenumber = 1 THEN 1 WHEN min(l_partkey) % 3 = 0 THEN 0 ELSE 2 END AS level FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey, para_no, level, CASE level WHEN 1 THEN '# 1 part ' || p WHEN 2 THEN '## 1.' || count(*) FILTER (level = 2) OVER (PARTITION BY l_orderkey ORDER BY para_no) || ' part ' || p ELSE '' END AS heading, CASE level WHEN 0 THEN 'part ' || p || '。rest' ELSE 'rest' END AS body
FROM l"""
)
def H6_number_paragraphs(spark, sf_dir):
    """The lines of each order: a first one is the title, others are by their part a heading with an old number or text."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("para_no")).agg(F.min("l_partkey").alias("p"))
    old = F.when(F.col("para_no") == 1, "三、").when(F.col("p") % 3 == 0, "").otherwise("（二）")
    paras = lines.select("l_orderkey", "para_no", F.concat(old, F.lit("part "), F.col("p").cast("string"), F.lit("。rest")).alias("text"))
    found = H.headings_from_paragraphs(paras, ["l_orderkey"], {1: "{1.arabic_half} ", 2: "{1.arabic_half}.{2.arabic_half} "})
    return found.withColumn("heading", F.coalesce("heading", F.lit("")))
