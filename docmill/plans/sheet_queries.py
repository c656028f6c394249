"""Spreadsheet queries over cells composed from ``lineitem`` and ``nation``: a sheet for each supplier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.operators import sheets as C
from docmill.plans.common import Queries, table

query = Queries()
QUERIES, ORACLES = query.QUERIES, query.ORACLES


def ranked_lines(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(order))


def cells(spark, sf_dir, collect: bool = False):
    """Columns key, quantity, price, flag. The collected sheet is shifted up and left by (l_suppkey mod 5, l_suppkey mod 3)."""
    rows = ranked_lines(spark, sf_dir).withColumn("sheet", F.col("l_suppkey"))
    dr, dc = ((F.col("sheet") % 5).cast("int"), (F.col("sheet") % 3).cast("int")) if collect else (F.lit(0), F.lit(0))
    if collect:
        rows = rows.filter("r % 3 > 0")
    values = [F.concat_ws("-", "l_orderkey", "l_linenumber"), F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), F.col("l_returnflag")]
    placed = F.array(*(F.struct((F.lit(20 + j) - dc).alias("col"), v.alias("value")) for j, v in enumerate(values)))
    return rows.select("sheet", (F.col("r") + 20 - dr).alias("row"), F.explode(placed).alias("c")).select("sheet", "row", "c.col", "c.value")


LINES = "l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag) AS r FROM lineitem)"


@query(
    f"""WITH {LINES}, c AS (SELECT l_suppkey AS sheet, r // 4 AS g, first(l_orderkey || '-' || l_linenumber ORDER BY r) AS v, min(r)::INTEGER AS a, max(r)::INTEGER AS b FROM l GROUP BY ALL)
SELECT sheet, unnest(range(a, b + 1))::INTEGER AS row, 1 AS col, v AS value FROM c"""
)
def C1_fill_merged(spark, sf_dir):
    rows = ranked_lines(spark, sf_dir).select(F.col("l_suppkey").alias("sheet"), F.col("r").alias("row"), F.lit(1).alias("col"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("value"))
    ranges = rows.groupBy("sheet", F.floor(F.col("row") / 4).alias("g")).agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.lit(1).alias("min_col"), F.lit(1).alias("max_col"))
    return C.fill_merged(rows, ranges.drop("g"), ["sheet"])


GRID = "g AS (SELECT o_custkey AS sheet, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS i, 'o' || o_orderkey AS n_name FROM orders)"


def grid(spark, sf_dir):
    """A sheet for each customer; its order i is a 2 x 3 box at row 4 i and column 5 (i mod 2)."""
    n = table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint"))
    n = n.withColumn("n_name", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    spots = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1, 2)))
    rows = n.select(F.col("o_custkey").alias("sheet"), "i", "n_name", F.explode(spots).alias("s"))
    row, col = F.col("i") * 4 + F.col("s.r"), F.pmod("i", F.lit(2)) * 5 + F.col("s.c")
    return rows.select("sheet", row.alias("row"), col.alias("col"), F.concat("n_name", F.lit("|"), "s.r", F.lit("\n"), "s.c").alias("value"))


@query(f"WITH {GRID} SELECT sheet, i * 4 AS min_row, i % 2 * 5 AS min_col, i * 4 + 1 AS max_row, i % 2 * 5 + 2 AS max_col FROM g")
def C2_find_blocks(spark, sf_dir):
    return C.find_blocks(grid(spark, sf_dir), ["sheet"])


@query(
    f"""WITH {GRID} SELECT sheet, i * 4 AS min_row, i % 2 * 5 AS min_col,
  '| ' || n_name || '\\|0<br>0 | ' || n_name || '\\|0<br>1 | ' || n_name || '\\|0<br>2 |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
  '| ' || n_name || '\\|1<br>0 | ' || n_name || '\\|1<br>1 | ' || n_name || '\\|1<br>2 |' AS markdown FROM g"""
)
def C3_blocks_to_markdown(spark, sf_dir):
    rows = grid(spark, sf_dir)
    return C.blocks_to_markdown(rows, C.find_blocks(rows, ["sheet"]), ["sheet"])


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN 'num' WHEN 1 THEN 'str' WHEN 2 THEN 'date' END AS kind,
  CASE l_orderkey % 4 WHEN 1 THEN l_returnflag WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') END AS key, CASE l_orderkey % 4 WHEN 0 THEN l_quantity END AS number FROM lineitem"""
)
def C4_normalize_cell(spark, sf_dir):
    k = F.col("l_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit("0"))).when(k == 1, F.concat("l_returnflag", F.lit(" "))).when(k == 2, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("  ")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.normalize_cell(raw).alias("n"))
    number = F.when(F.col("n.kind") == "num", F.col("n.key").cast("double"))
    return rows.select("l_orderkey", "l_linenumber", "n.kind", F.when(F.col("n.kind") != "num", F.col("n.key")).alias("key"), number.alias("number"))


BASE = f"""{LINES}, base AS (SELECT l_suppkey AS sheet, r + 20 AS row, unnest([20, 21, 22, 23]) AS col, unnest(['s' || l_orderkey || '-' || l_linenumber, 'n' || l_quantity, 'n' || l_extendedprice, 's' || l_returnflag]) AS k, r FROM l),
coll AS (SELECT sheet, row - sheet % 5 AS row, col - sheet % 3 AS col, k FROM base WHERE r % 3 > 0)"""


@query(
    f"""WITH {BASE}, c AS (SELECT * FROM coll QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY row, col) <= 500),
m AS (SELECT c.sheet, b.row - c.row AS dr, b.col - c.col AS dc, count(*) AS n FROM c JOIN base b ON b.sheet = c.sheet AND b.k = c.k AND abs(b.row - c.row) <= 10 AND abs(b.col - c.col) <= 10 GROUP BY ALL)
SELECT sheet, dr::INTEGER AS dr, dc::INTEGER AS dc, n FROM m QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY n DESC, dr, dc) = 1"""
)
def C5_align_tables(spark, sf_dir):
    return C.align_tables(cells(spark, sf_dir), cells(spark, sf_dir, collect=True), ["sheet"])


def aligned_files(spark, sf_dir):
    base, collect = cells(spark, sf_dir), cells(spark, sf_dir, collect=True)
    offsets = C.align_tables(base, collect, ["sheet"])
    moved = collect.join(offsets, "sheet").select("sheet", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "value")
    return base.withColumn("file_no", F.lit(0)).unionByName(moved.withColumn("file_no", F.lit(1)))


@query(
    f"""WITH {LINES}
SELECT l_suppkey AS sheet, r + 20 AS row, r % 3 > 0 AS twice, l_orderkey || '-' || l_linenumber AS c20, round((CASE WHEN r % 3 > 0 THEN 2 ELSE 1 END) * l_quantity, 4) AS c21,
       round((CASE WHEN r % 3 > 0 THEN 2 ELSE 1 END) * l_extendedprice, 4) AS c22, l_returnflag AS c23 FROM l"""
)
def C6_merge_by_cell(spark, sf_dir):
    files = aligned_files(spark, sf_dir)
    merged = C.merge_by_cell(files, ["sheet"])
    wide = merged.groupBy("sheet", "row").agg(*(F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"c{c}") for c in (20, 21, 22, 23)))
    return wide.select("sheet", "row", ((F.col("row") - 20) % 3 > 0).alias("twice"), "c20", F.round(F.col("c21").cast("double"), 4).alias("c21"), F.round(F.col("c22").cast("double"), 4).alias("c22"), "c23")


_COVER = """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 5 WHEN 0 THEN 'base_covers_collect' WHEN 1 THEN 'collect_covers_base' WHEN 2 THEN 'conflict' WHEN 3 THEN 'base_covers_collect' ELSE 'skip_empty' END AS relation FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"""


def _cover(spark, sf_dir, index: str):
    """Base K, 2; collected: K and blank; K, "2.0", X; K and 3; the same; blank."""
    rows, k = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("string").alias("q")), F.col("l_orderkey") % 5
    base = rows.select("l_orderkey", "l_linenumber", F.posexplode(F.array(F.lit("K"), F.col("q"))).alias(index, "value"))
    told = (
        F.when(k == 0, F.array(F.lit("K"), F.lit(" ")))
        .when(k == 1, F.array(F.lit("K"), F.concat("q", F.lit("0")), F.lit("X")))
        .when(k == 2, F.array(F.lit("K"), F.concat(F.lit("1"), F.col("q"))))
        .when(k == 3, F.array(F.lit("K"), F.col("q")))
        .otherwise(F.array(F.lit(""), F.lit(" ")))
    )
    collect = rows.select("l_orderkey", "l_linenumber", F.posexplode(told).alias(index, "value"))
    return C.line_coverage(base, collect, ["l_orderkey", "l_linenumber"], index)


@query(_COVER)
def C7_row_coverage(spark, sf_dir):
    return _cover(spark, sf_dir, "col")


@query(_COVER)
def C7_column_coverage(spark, sf_dir):
    return _cover(spark, sf_dir, "row")


@query("SELECT l_orderkey, l_linenumber, (1 + CASE WHEN l_quantity = l_discount THEN 1 ELSE 0 END + CASE WHEN l_returnflag = l_linestatus THEN 1 ELSE 0 END + 1) / 4.0::DOUBLE AS similarity FROM lineitem")
def C8_line_similarity(spark, sf_dir):
    a = F.array(F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"), F.col("l_returnflag"), F.lit(""))
    b = F.array(F.concat(F.lit(" "), F.col("l_orderkey").cast("string")), F.col("l_discount").cast("string"), F.col("l_linestatus"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.line_similarity(a, b).alias("similarity"))


@query(
    """WITH p AS (SELECT p_brand, p_partkey, p_name, p_type, p_size::VARCHAR AS s FROM part),
m AS (SELECT c.p_brand, c.p_partkey AS line, b.p_partkey AS base_line, ((c.p_name = b.p_name)::INT + (c.p_type = b.p_type)::INT + (c.s = b.s)::INT) / 3.0::DOUBLE AS similarity
      FROM p c JOIN p b ON c.p_brand = b.p_brand AND c.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1 AND (c.p_name = b.p_name OR c.p_type = b.p_type OR c.s = b.s))
SELECT p.p_brand, p_partkey AS line, coalesce(base_line, 1) AS base_line, coalesce(similarity, 0) AS similarity FROM p LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_brand, line ORDER BY similarity DESC, base_line) = 1) m ON m.line = p_partkey AND m.p_brand = p.p_brand WHERE p_partkey % 2 = 0"""
)
def C9_most_similar_line(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("line"), F.array("p_name", "p_type", F.col("p_size").cast("string")).alias("cells"))
    return C.most_similar_line(parts.filter("line % 2 = 1"), parts.filter("line % 2 = 0"), ["p_brand"])


@query(
    """WITH p AS (SELECT p_brand, p_partkey, p_type AS a, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'same' ELSE p_name END AS b, CASE WHEN p_size % 5 > 0 THEN p_size::VARCHAR ELSE '' END AS c FROM part),
m AS (SELECT c.p_brand, c.p_partkey AS line, b.p_partkey AS base_line, ((c.a = b.a)::INT + (c.b = b.b)::INT + (c.c = b.c)::INT) / 3.0::DOUBLE AS similarity
      FROM p c JOIN p b ON c.p_brand = b.p_brand AND c.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1)
SELECT p.p_brand, p_partkey AS line, CASE WHEN similarity > 0 THEN base_line ELSE 1 END AS base_line, coalesce(similarity, 0) AS similarity FROM p LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_brand, line ORDER BY similarity DESC, base_line) = 1) m ON m.line = p_partkey AND m.p_brand = p.p_brand WHERE p_partkey % 2 = 0"""
)
def C9_similar_line_with_blanks(spark, sf_dir):
    """A third of the lines has an empty place, a third one common value there; one size in five is blank."""
    k, size = F.col("p_partkey"), F.col("p_size")
    middle = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit(" "))).when(k % 3 == 1, F.lit("same")).otherwise(F.col("p_name"))
    parts = table(spark, sf_dir, "part").select("p_brand", k.alias("line"), F.array("p_type", middle, F.when(size % 5 > 0, size.cast("string")).otherwise("")).alias("cells"))
    return C.most_similar_line(parts.filter("line % 2 = 1"), parts.filter("line % 2 = 0"), ["p_brand"])


def sheets_of_customers(spark, sf_dir):
    """Forty customers a sheet, so that sheets grow in number."""
    return table(spark, sf_dir, "customer").withColumn("sheet", F.floor(F.col("c_custkey") / 40))


@query(
    """WITH o AS (SELECT c_custkey // 40 AS sheet, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) AS line FROM customer)
SELECT sheet, line, [c_name, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END] AS cells FROM o"""
)
def C10_merge_by_row(spark, sf_dir):
    """Even customers' collected rows cover their base rows; odd ones' are covered."""
    rows = sheets_of_customers(spark, sf_dir).withColumn("line", F.row_number().over(Window.partitionBy("sheet").orderBy("c_custkey")).cast("bigint"))
    base = rows.select("sheet", "line", F.array("c_name", "c_mktsegment", F.lit("")).alias("cells"))
    more = F.when(F.col("c_custkey") % 2 == 0, F.array("c_name", "c_mktsegment", F.lit("x"))).otherwise(F.array("c_name", F.lit(""), F.lit("")))
    return C.merge_by_row(base, rows.select("sheet", "line", more.alias("cells")), ["sheet"])


@query(
    """SELECT c_custkey, row, col, value FROM (SELECT c_custkey, unnest([1, 2, 3, 1, 2, 3, 1, 2, 3]) AS row, unnest([1, 1, 1, 2, 2, 2, 3, 3, 3]) AS col,
  unnest([c_name, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'x' END, 'n', 'k' || c_custkey, '7', 'q', 'k' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '7.0' ELSE '7' END]) AS value FROM customer) WHERE value IS NOT NULL"""
)
def C10_merge_by_column(spark, sf_dir):
    """A sheet for each customer: the first collected column covers the first base column or is covered by it, the second is blank, the third, which differs from the second base column in one place, goes beside it."""
    k = F.col("c_custkey")
    other = lambda sign, seven: F.array(F.lit(sign), F.concat(F.lit("k"), k.cast("string")), seven)
    seven = F.when(k % 3 == 0, "7.0").otherwise("7")
    told = F.when(k % 2 == 0, F.array("c_name", "c_mktsegment", F.lit("x"))).otherwise(F.array(F.col("c_name"), F.lit("  ")))
    sheets = {"base": F.array(F.array("c_name", "c_mktsegment"), other("n", F.lit("7"))), "collect": F.array(told, F.array(F.lit(" ")), other("q", seven))}

    def cells(columns):
        rows = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(columns).alias("c", "_x"))
        return rows.select("c_custkey", (F.col("c") + 1).alias("col"), F.posexplode("_x").alias("r", "value")).select("c_custkey", (F.col("r") + 1).alias("row"), "col", "value")

    return C.merge_by_column(cells(sheets["base"]), cells(sheets["collect"]), ["c_custkey"])


@query(
    """SELECT p_partkey, 0 AS n, CASE p_partkey % 3 WHEN 0 THEN 'scalar' WHEN 1 THEN 'column' ELSE 'row' END AS mode, p_name AS key, p_partkey % 2 = 0 AS whole FROM part
UNION ALL SELECT p_partkey, 1, 'scalar', 'more', false FROM part WHERE p_partkey % 2 = 1"""
)
def C11_template_placeholders(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("{{"), F.when(k % 3 == 0, "").when(k % 3 == 1, "↓").otherwise("→"), F.col("p_name"), F.lit("}}"), F.when(k % 2 == 1, " and {{more}}").otherwise(""))
    return C.template_placeholders(table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))).drop("text")


def records(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    pairs = [("name", F.array("c_name")), ("both", F.array("c_name", "c_mktsegment")), ("half", F.array(F.concat("c_nationkey", F.lit("/7")))), ("code", F.array(F.concat(F.lit("12345678901"), 10000 + F.col("c_custkey")))), ("size", F.array(F.col("c_nationkey").cast("string"))), ("note", F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("n"))).otherwise(F.array(F.lit(" "))))]
    return rows.select("c_custkey", F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))).alias("record"))


@query(
    """SELECT c_custkey, cell, CASE cell WHEN 1 THEN 'To ' || c_name || '!' WHEN 2 THEN c_name || '、' || c_mktsegment WHEN 3 THEN '=' || c_nationkey || '/7' WHEN 4 THEN '12345678901' || (10000 + c_custkey) WHEN 5 THEN c_nationkey::VARCHAR ELSE '' END AS value,
  CASE cell WHEN 3 THEN 'formula' WHEN 5 THEN 'number' ELSE 'text' END AS vtype FROM customer, (VALUES (1), (2), (3), (4), (5), (6)) AS t(cell)"""
)
def C12_fill_cells(spark, sf_dir):
    template = spark.createDataFrame([(1, "To {{name}}!"), (2, "{{both}}"), (3, "{{half}}"), (4, "{{code}}"), (5, "{{size}}"), (6, "{{unknown}}")], "cell int, text string")
    return C.fill_cells(template, records(spark, sf_dir), ["name", "both", "half", "code", "size"]).drop("text")


@query(
    """WITH v AS (SELECT c_custkey // 40 AS sheet, c_name, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) AS value_no FROM customer)
SELECT sheet, 'name' AS key, CASE WHEN value_no <= 2 THEN value_no + 1 ELSE value_no + 3 END AS row, 2 AS col, value_no, c_name AS value FROM v"""
)
def C13_fill_columns(spark, sf_dir):
    """A merged range covers rows 3 to 5 of the column: its first cell takes the second value, the next two none."""
    rows = sheets_of_customers(spark, sf_dir).select("sheet", F.lit("name").alias("key"), F.row_number().over(Window.partitionBy("sheet").orderBy("c_custkey")).alias("value_no"), F.col("c_name").alias("value"))
    slots = spark.createDataFrame([("name", 2, 2)], "key string, row int, col int")
    merged = spark.createDataFrame([(3, 2, 5, 3)], "min_row int, min_col int, max_row int, max_col int")
    return C.fill_down(slots, rows, merged, ["sheet"])


@query(
    """WITH c AS (SELECT c_custkey // 40 AS sheet, 'name' AS key, c_name AS value, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) AS value_no FROM customer)
SELECT sheet, key, 2 AS row, 1 + value_no + CASE WHEN value_no > 2 THEN 1 ELSE 0 END AS col, value_no, value, value_no <> 4 AS written FROM c"""
)
def C13_fill_rows(spark, sf_dir):
    """To the right from column 2: a merged range covers columns 3 and 4, and column 6, the fourth value's, is protected."""
    rows = sheets_of_customers(spark, sf_dir).select("sheet", F.lit("name").alias("key"), F.row_number().over(Window.partitionBy("sheet").orderBy("c_custkey")).alias("value_no"), F.col("c_name").alias("value"))
    slots = spark.createDataFrame([("name", 2, 2)], "key string, row int, col int")
    merged = spark.createDataFrame([(2, 3, 3, 4)], "min_row int, min_col int, max_row int, max_col int")
    return C.fill_right(slots, rows, merged, ["sheet"], spark.createDataFrame([(2, 6), (9, 9)], "row int, col int"))


@query(
    """SELECT c_custkey, para, CASE para WHEN 1 THEN 'Dear ' || c_name || ':' WHEN 2 THEN 'Note: n' ELSE 'End ' END AS text FROM customer, (VALUES (1), (2), (3)) AS t(para) WHERE para <> 2 OR c_custkey % 2 = 0"""
)
def C14_fill_paragraphs(spark, sf_dir):
    template = spark.createDataFrame([(1, "Dear {{name}}:"), (2, "Note: {{note}}"), (3, "End {{unknown}}")], "para int, text string")
    return C.fill_paragraphs(template, records(spark, sf_dir), ["name", "note"], [["note"]])
