"""Markdown and link queries over documents composed from the star schema; the SQL works on the source columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import links as L
from docmill.operators import markdown as M
from docmill.plans.common import Queries, table
from docmill.storage import sorted_side

query = Queries()
QUERIES, ORACLES = query.QUERIES, query.ORACLES


def cat(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def md_nations(spark, sf_dir):
    """Front matter, headings and a table of the nation's customers; the third customer of each nation has a pipe in its name; an equal table stands in a fence."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer")
    row = cat("| ", F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, "\\|x").otherwise(""), " | ", F.col("c_custkey").cast("string"), " | ", F.col("c_mktsegment"), " |")
    rows = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", row.alias("r")))).alias("rs"))
    n = n.join(rows, "n_nationkey")
    body = F.array_join(F.transform("rs", lambda x: x["r"]), "\n")
    text = cat(
        "---\ntitle: ", F.col("n_name"), "\naliases:\n  - ", F.col("r_name"), "\n  - both: not\nkey: ", F.col("n_nationkey").cast("string"), "\nflag: yes\n---\n# ", F.col("r_name"), "\n\ntext before\n\n## ", F.col("n_name"),
        "\n\n| Name | Key | Segment |\n| :--- | ---: | :-: |\n", body, "\n\nafter\n\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n\n### Deep ", F.col("n_name"), "\nlow\n\n",
    )
    return n.select("n_nationkey", text.alias("text"))


FRONT = """'title: ' || n_name || chr(10) || 'aliases:' || chr(10) || '  - ' || r_name || chr(10) || '  - both: not' || chr(10) || 'key: ' || n_nationkey || chr(10) || 'flag: yes'"""
NATIONS = "nation JOIN region ON n_regionkey = r_regionkey"
SHOWN = "c_name || CASE WHEN c_custkey % 3 = 0 THEN '|x' ELSE '' END"


@query(f"SELECT n_nationkey, {FRONT} AS yaml, '# ' || r_name AS first_line FROM {NATIONS}")
def M1_split_front_matter(spark, sf_dir):
    rows = md_nations(spark, sf_dir).select("n_nationkey", M.split_front_matter(F.col("text")).alias("s"))
    return rows.select("n_nationkey", "s.yaml", F.substring_index("s.body", "\n", 1).alias("first_line"))


@query(f"SELECT n_nationkey, n_name AS title, [r_name, '{{''both'': ''not''}}'] AS aliases, n_nationkey::VARCHAR AS key, 'true' AS flag FROM {NATIONS}")
def M1b_parse_front_matter(spark, sf_dir):
    rows = md_nations(spark, sf_dir).select("n_nationkey", M.parse_front_matter(M.split_front_matter(F.col("text"))["yaml"]).alias("m"))
    return rows.select("n_nationkey", F.col("m.title")[0].alias("title"), F.col("m.aliases").alias("aliases"), F.col("m.key")[0].alias("key"), F.col("m.flag")[0].alias("flag"))


@query(f"SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN r_name ELSE 'file ' || n_nationkey END AS title FROM {NATIONS}")
def M1c_resolve_title(spark, sf_dir):
    rows = md_nations(spark, sf_dir).select("n_nationkey", M.parse_front_matter(M.split_front_matter(F.col("text"))["yaml"]).alias("m"))
    k = F.col("n_nationkey") % 3
    kept = F.map_filter("m", lambda key, v: ((key == "title") & (k == 0)) | ((key == "aliases") & (k == 1)))
    return rows.select("n_nationkey", M.resolve_title(kept, cat("file ", F.col("n_nationkey").cast("string"))).alias("title"))


KINDS = ("heading", "heading", "heading", "code", "hr", "formula", "table", "quote", "bullet", "ordered", "paragraph", "bullet")


@query(
    f"""WITH p AS (SELECT p_brand, p_partkey, p_name AS n, p_partkey % 12 AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_brand, (2 * i + j)::INTEGER AS seq, CASE WHEN j = 1 THEN 'paragraph' ELSE {list(KINDS)}[k + 1] END AS type,
  CASE WHEN j = 1 THEN -1 WHEN k = 0 THEN 3 WHEN k = 1 THEN 1 WHEN k = 2 THEN 2 WHEN k = 7 THEN 2 WHEN k IN (8, 9, 11) THEN 1 ELSE -1 END AS level,
  CASE WHEN j = 1 THEN 'end' WHEN k = 3 THEN '# ' || n || chr(10) || '  x' WHEN k = 4 THEN '*' WHEN k = 5 THEN n || chr(10) || '= 1' WHEN k = 6 THEN '| ' || n || ' |' || chr(10) || '|---|' || chr(10) || '| 1 |' WHEN k = 11 THEN n || chr(10) || 'more' ELSE n END AS text,
  CASE WHEN j = 0 AND k = 3 THEN 'sql' ELSE '' END AS language, -1 AS list_level, j = 0 AND k = 5 AS has_formula, false AS in_list_context FROM p, (VALUES (0), (1)) AS t(j)"""
)
def M2_segment_blocks(spark, sf_dir):
    """A document for each brand, a block for each part by its number, and a paragraph after each."""
    n, k = F.col("p_name"), F.col("p_partkey") % 12
    lines = [cat("### ", n), cat(n, "\n==="), cat(n, "\n---"), cat("  ```sql\n  # ", n, "\n    x\n  ```"), F.lit("* * *"), cat("$$", n, "\n= 1 $$"), cat("| ", n, " |\n|---|\n| 1 |"), cat("> > ", n), cat("- ", n), cat("12. ", n), n, cat("+ ", n, "\n  more")]
    line = F.element_at(F.array(*lines), (k + 1).cast("int"))
    docs = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", cat(line, "\n\nend\n").alias("l")))).alias("ls"))
    found = M.segment_blocks(docs.select("p_brand", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("text")))
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("level", "list_level")}).drop("attached")


@query(
    """SELECT o_orderkey, seq, type, coalesce(level, -1) AS level, text, list_level, has_formula, list_level > 0 AS in_list_context FROM (SELECT o_orderkey, unnest([0, 1, 2, 3, 4, 5]) AS seq, unnest(['bullet', 'bullet', 'code', 'code', 'bullet', 'quote']) AS type,
  unnest([1, 2, NULL, NULL, 2, 1]) AS level, unnest([o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN '$x$' ELSE 'cost $5' END, o_orderstatus, 'y', 'last', 'q $$z$$ ' || o_orderstatus]) AS text,
  unnest([-1, -1, CASE o_orderkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 2 END, -1, -1, -1]) AS list_level, unnest([false, o_orderkey % 2 = 0, false, false, false, true]) AS has_formula FROM orders)"""
)
def M2_list_context(spark, sf_dir):
    """A document for each order: code without indent, below an item, or below an item of the second level; code doesn't end the list; formulas in items and quotes."""
    k = F.col("o_orderkey")
    indent = F.when(k % 3 == 0, "").when(k % 3 == 1, "  ").otherwise("    ")
    formula = F.when(k % 2 == 0, "$x$").otherwise("cost $5")
    text = cat("- ", F.col("o_orderpriority"), "\n    - ", formula, "\n", indent, "```\n", indent, F.col("o_orderstatus"), "\n", indent, "```\n\n```\ny\n```\n    - last\n> q $$z$$ ", F.col("o_orderstatus"))
    found = M.segment_blocks(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")))
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("level", "list_level")}).drop("attached", "language")


@query(
    """SELECT o_orderkey, seq, type, level, text, attached, content FROM (SELECT o_orderkey, unnest([0, 1, 2, 3]) AS seq,
  unnest([CASE WHEN k < 3 THEN 'heading_with_content' ELSE 'heading' END, CASE WHEN k < 3 THEN NULL ELSE 'paragraph' END, 'hr', 'paragraph']) AS type, unnest([2, -1, -1, -1]) AS level,
  unnest([h || ['.', '。', '！', '', '?'][k + 1], o_orderpriority, '*', 'end']) AS text, unnest([false, k < 4, k % 2 = 0, false]) AS attached,
  unnest([CASE k WHEN 0 THEN ' ' || o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN o_orderpriority ELSE '' END, '', '', '']) AS content
  FROM (SELECT o_orderkey, o_orderkey % 5 AS k, 'h' || o_orderkey AS h, o_orderpriority FROM orders)) WHERE type IS NOT NULL"""
)
def M2_heading_content(spark, sf_dir):
    """A document for each order: a heading, which ends in a sign unless the key mod 5 is 3, a line right below it unless that is 4, and a rule that belongs to the line where the key mod 5 is even."""
    k = F.col("o_orderkey") % 5
    sign = F.element_at(F.array(*map(F.lit, (".", "。", "！", "", "?"))), (k + 1).cast("int"))
    text = cat("## h", F.col("o_orderkey").cast("string"), sign, F.when(k == 4, "\n\n").otherwise("\n"), F.col("o_orderpriority"), F.when(k % 2 == 0, "\n***\n").otherwise("\n\n***\n"), "\nend")
    found = M.merge_heading_content(M.segment_blocks(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))), ["o_orderkey"])
    return found.select("o_orderkey", "seq", "type", F.coalesce("level", F.lit(-1)).alias("level"), "text", "attached", F.coalesce("content", F.lit("")).alias("content"))


@query(
    f"""SELECT n_nationkey, 0 AS table_no, ['Name', 'Key', 'Segment'] AS headers, ['left', 'right', 'center'] AS alignments, n AS n_rows, f AS first_row, 14 AS start_line, (16 + n)::INTEGER AS end_line
FROM (SELECT c_nationkey AS n_nationkey, count(*)::INTEGER AS n, first([{SHOWN}, c_custkey::VARCHAR, c_mktsegment] ORDER BY c_custkey) AS f FROM customer GROUP BY ALL)"""
)
def M3_extract_tables(spark, sf_dir):
    found = M.extract_tables(md_nations(spark, sf_dir))
    return found.select("n_nationkey", "table_no", "headers", "alignments", F.size("rows").alias("n_rows"), F.get("rows", F.lit(0)).alias("first_row"), "start_line", "end_line")


@query(
    f"""SELECT c_nationkey AS n_nationkey, h AS header, count(*)::INTEGER AS n, string_agg(CASE h WHEN 'Name' THEN {SHOWN} WHEN 'Key' THEN c_custkey::VARCHAR ELSE c_mktsegment END, ';' ORDER BY c_custkey) AS vals, h = 'Key' AS numbers
FROM customer, (VALUES ('Name'), ('Key'), ('Segment')) AS t(h) GROUP BY ALL"""
)
def M4_table_columns(spark, sf_dir):
    found = M.table_columns(M.extract_tables(md_nations(spark, sf_dir)), ["n_nationkey"])
    return found.select(
        "n_nationkey", "header", F.size("values").alias("n"), F.array_join(F.transform("values", lambda v: v["value"]), ";").alias("vals"), F.forall("values", lambda v: v["vtype"] == "number").alias("numbers")
    )


def md_notes(spark, sf_dir):
    """One document per order: a reference for each line and a definition unless the line's part is a multiple of seven; odd lines are endnotes with a second line."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    name = cat(F.when(F.col("l_linenumber") % 2 == 1, "endnote-").otherwise(""), F.col("l_linenumber").cast("string"))
    note = cat("[^", name, "]: part ", F.col("p").cast("string"), F.when(F.col("l_linenumber") % 2 == 1, "\n\n    more").otherwise(""))
    note = F.when(F.col("p") % 7 != 0, note)
    docs = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct((-F.col("l_linenumber")).alias("k"), cat("see [^", name, "] here").alias("ref"), note.alias("note")))).alias("ls"))
    refs, notes = F.transform("ls", lambda x: x["ref"]), F.filter(F.transform("ls", lambda x: x["note"]), lambda x: x.isNotNull())
    return docs.select("l_orderkey", cat(F.array_join(refs, "\n"), "\n\n", F.array_join(notes, "\n")).alias("text"))


NOTES = """n AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, CASE WHEN l_linenumber % 2 = 1 THEN 'endnote' ELSE 'footnote' END AS kind, l_linenumber::VARCHAR AS note_id FROM lineitem GROUP BY ALL)"""
CONTENT = "'part ' || p || CASE WHEN l_linenumber % 2 = 1 THEN chr(10) || chr(10) || 'more' ELSE '' END"


@query(f"WITH {NOTES} SELECT l_orderkey, kind, note_id, {CONTENT} AS content FROM n WHERE p % 7 <> 0")
def M5_extract_notes(spark, sf_dir):
    return M.extract_notes(md_notes(spark, sf_dir))


@query(f"WITH {NOTES} SELECT l_orderkey, kind, note_id, CASE WHEN p % 7 <> 0 THEN row_number() OVER (PARTITION BY l_orderkey, kind, p % 7 <> 0 ORDER BY l_linenumber DESC) ELSE -1 END AS number FROM n")
def M6_number_notes(spark, sf_dir):
    docs = md_notes(spark, sf_dir)
    found = M.number_notes(M.note_references(docs), M.extract_notes(docs), ["l_orderkey"])
    return found.withColumn("number", F.coalesce("number", F.lit(-1)).cast("bigint"))


@query(
    f"""WITH {NOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY l_linenumber) AS i FROM n WHERE p % 7 <> 0)
SELECT l_orderkey, string_agg('[^' || CASE kind WHEN 'endnote' THEN 'endnote-' ELSE '' END || i || ']: ' || replace({CONTENT}, chr(10), chr(10) || '    '), chr(10) ORDER BY kind DESC, i) AS block FROM r GROUP BY l_orderkey"""
)
def M7_render_notes(spark, sf_dir):
    return M.render_notes(M.extract_notes(md_notes(spark, sf_dir)), ["l_orderkey"])


@query("SELECT p_partkey, 0 AS n, false AS is_inline, 'x_1 = ' || p_size AS latex FROM part UNION ALL SELECT p_partkey, 1, true, p_name FROM part")
def M8_extract_formulas(spark, sf_dir):
    text = cat("a $$\nx_1\n= ", F.col("p_size").cast("string"), "\n$$ and $", F.col("p_name"), "$ or \\$5 and 6$")
    found = M.extract_formulas(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")))
    return found


@query(f"SELECT n_nationkey, chr(10) || 'low' AS deep, '# ' || r_name AS top, true AS missing FROM {NATIONS}")
def M9_extract_section(spark, sf_dir):
    rows = md_nations(spark, sf_dir).join(table(spark, sf_dir, "nation"), "n_nationkey").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = M.split_front_matter(F.col("text"))["body"]
    deep = M.extract_section(body, cat(" deep", F.lower("n_name")))
    return rows.select(
        "n_nationkey", F.regexp_replace(deep, r"\A[^\n]*", "").alias("deep"), F.substring_index(M.extract_section(body, F.col("r_name")), "\n", 1).alias("top"), M.extract_section(body, F.lit("none")).isNull().alias("missing")
    )


@query("SELECT p_partkey, p_name || chr(10) || 'second' AS one, p_brand AS two, true AS missing FROM part")
def M10_extract_block(spark, sf_dir):
    text = cat("# head\n", F.col("p_name"), "\nsecond ^b-1\n", F.col("p_brand"), "\n\n^b2\nend")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", *(M.extract_block(F.col("text"), F.lit(b)).alias(n) for b, n in (("b-1", "one"), ("b2", "two"))), M.extract_block(F.col("text"), F.lit("b3")).isNull().alias("missing"))


@query(
    """WITH p AS (SELECT *, lag(p_size % 2) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
SELECT p_brand, string_agg(CASE WHEN b IS NULL THEN '' WHEN b = 0 AND p_size % 2 = 0 THEN chr(10) ELSE chr(10) || chr(10) END || p_name, '' ORDER BY p_partkey) AS text FROM p GROUP BY p_brand"""
)
def M11_smart_join_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("seq"), (F.col("p_size") % 2 == 0).alias("is_list"), F.col("p_name").alias("line"))
    return M.smart_join_blocks(rows, ["p_brand"])


@query(
    """WITH p AS (SELECT p_brand, p_partkey AS seq, CASE WHEN p_size % 9 < 8 THEN p_size % 3 END AS level FROM part),
i AS (SELECT *, count(*) FILTER (level IS NULL) OVER (PARTITION BY p_brand ORDER BY seq) AS isl FROM p)
SELECT a.p_brand, a.seq, coalesce(a.level, -1)::INTEGER AS level, CASE WHEN a.level IS NULL THEN -1 ELSE (SELECT count(*) FROM i b WHERE b.p_brand = a.p_brand AND b.isl = a.isl AND b.level = a.level AND b.seq <= a.seq
  AND NOT EXISTS (SELECT 1 FROM i c WHERE c.p_brand = a.p_brand AND c.isl = a.isl AND c.level < a.level AND c.seq > b.seq AND c.seq <= a.seq)) END AS counter FROM i a"""
)
def M12_list_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("seq"), F.lit(1).alias("list_id"), F.when(F.col("p_size") % 9 < 8, F.col("p_size") % 3).alias("level"))
    found = M.list_counters(rows, ["p_brand"])
    return found.select("p_brand", "seq", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("counter", F.lit(-1)).cast("bigint").alias("counter"))


@query(
    """WITH o AS (SELECT p_partkey, p_name, p_size, '![[' || p_name || '.png|' || p_size || 'x7]]' AS a, '![alt](' || p_partkey || '.png =30x)' AS b, '[[' || p_name || '|see]]' AS c, '[go](u' || p_size || ')' AS d FROM part)
SELECT p_partkey, 'wiki_embed' AS kind, 2 AS pos, p_name || '.png' AS link, '' AS display, p_size AS width, 7 AS height FROM o
UNION ALL SELECT p_partkey, 'md_embed', length(a) + 3, p_partkey || '.png', 'alt', 30, -1 FROM o
UNION ALL SELECT p_partkey, 'wiki_link', length(a) + length(b) + 3, p_name, 'see', -1, -1 FROM o
UNION ALL SELECT p_partkey, 'md_link', length(a) + length(b) + length(c) + 4, 'u' || p_size, 'go', -1, -1 FROM o"""
)
def L1_extract_links(spark, sf_dir):
    text = cat("é ", "![[", F.col("p_name"), ".png|", F.col("p_size").cast("string"), "x7]] ![alt](", F.col("p_partkey").cast("string"), ".png =30x)[[", F.col("p_name"), "|see]] [go](u", F.col("p_size").cast("string"), ")")
    found = L.extract_links(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")))
    return found.select("p_partkey", "kind", F.col("pos").cast("int").alias("pos"), "link", "display", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("width", "height")))


@query("SELECT p_partkey, p_name || '+.md' AS path, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS heading, CASE WHEN p_partkey % 2 = 1 THEN 'b' || p_partkey END AS block_id FROM part")
def L2_parse_target(spark, sf_dir):
    link = cat(F.replace("p_name", F.lit(" "), F.lit("%20")), "+.md#", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(cat("^b", F.col("p_partkey").cast("string"))), "?v=1")
    return table(spark, sf_dir, "part").select("p_partkey", L.parse_target(link).alias("t")).select("p_partkey", "t.*")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/x.md' WHEN 1 THEN 'lib/pic.png' WHEN 2 THEN 'a/' || p_partkey || '/y.md' END AS resolved, CASE p_partkey % 4 WHEN 1 THEN 'image' WHEN 3 THEN NULL ELSE 'markdown' END AS file_type FROM part")
def L3_resolve_links(spark, sf_dir):
    k = F.col("p_partkey")
    links = table(spark, sf_dir, "part").select("p_partkey", cat("a/", k.cast("string"), ".md").alias("source_path"), F.when(k % 4 == 0, "x").when(k % 4 == 1, "pic.png").when(k % 4 == 2, "y").otherwise("none/z").alias("target"))
    files = links.filter(k % 4 == 2).select(F.regexp_replace("source_path", r"\.md$", "/y.md").alias("path")).union(spark.createDataFrame([("a/x.md",), ("lib/pic.png",), ("lib/x.md",)], "path string"))
    return L.resolve_links(links, files, ["p_partkey"], ("lib",))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/x.md' WHEN 1 THEN 'lib/pic.png' WHEN 2 THEN 'a/' || p_partkey || '/y.md' END AS resolved, CASE p_partkey % 4 WHEN 1 THEN 'image' WHEN 3 THEN NULL ELSE 'markdown' END AS file_type FROM part")
def L3_resolve_folded_paths(spark, sf_dir):
    """Targets above the note's folder, with dots in the middle, and above the top, where nothing is."""
    k = F.col("p_partkey")
    target = F.when(k % 4 == 0, "../x").when(k % 4 == 1, "../.././lib//pic.png").when(k % 4 == 2, "z/../y").otherwise("../../../x")
    links = table(spark, sf_dir, "part").select("p_partkey", cat("a/", k.cast("string"), "/n.md").alias("source_path"), target.alias("target"))
    files = links.filter(k % 4 == 2).select(F.regexp_replace("source_path", r"n\.md$", "y.md").alias("path")).union(spark.createDataFrame([("a/x.md",), ("lib/pic.png",), ("x.md",)], "path string"))
    return L.resolve_links(links, files, ["p_partkey"])


@query("SELECT p_partkey, 'a {{IMAGE:' || p_name || '.png}} ' || p_brand || ' ' || p_type || ' b' AS shown, 'a ![[' || p_name || '.png]]   b' AS bare FROM part")
def L4_rewrite_links(spark, sf_dir):
    text = cat("a ![[", F.col("p_name"), ".png]] [[x|", F.col("p_brand"), "]] [", F.col("p_type"), "](u) b")
    return table(spark, sf_dir, "part").select("p_partkey", L.rewrite_links(text, embeds="placeholder").alias("shown"), L.rewrite_links(text, "remove", "remove").alias("bare"))


def md_links(spark, sf_dir):
    """A customer's note embeds its nation's, itself, a missing file; a nation's embeds a section of its first customer's."""
    c, n = table(spark, sf_dir, "customer").withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit("-"))), table(spark, sf_dir, "nation")
    first = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min_by("c_name", "c_custkey").alias("f"))
    named = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    text = cat("---\na: b\n---\nN ", F.col("c_name"), " <![[", F.col("n_name"), "]]> <![[", F.col("c_name"), ".md]]> <![[none]]>\n## S\nsec ", F.col("c_name"))
    docs = named.select(cat(F.col("c_name"), ".md").alias("path"), text.alias("text"))
    return docs.unionByName(n.join(first, "n_nationkey").select(cat(F.col("n_name"), ".md").alias("path"), cat("R ", F.col("n_name"), " (![[", F.col("f"), "#s]])").alias("text")))


@query(
    f"""WITH c AS (SELECT c_custkey, c_nationkey, replace(c_name, '#', '-') AS c_name FROM customer),
f AS (SELECT c_nationkey AS k, min_by(c_name, c_custkey) AS f FROM c GROUP BY ALL),
r AS (SELECT n_nationkey, n_name, 'R ' || n_name || ' (' AS a, f FROM nation JOIN f ON k = n_nationkey)
SELECT c_name || '.md' AS path, '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || 'N ' || c_name || ' <' || a || CASE WHEN f = c_name THEN '[cycle: ' || f || '#s]' ELSE '## S' || chr(10) || 'sec ' || f END || ')> <[cycle: ' || c_name || '.md]> <[not found: none]>' || chr(10) || '## S' || chr(10) || 'sec ' || c_name AS text
FROM c JOIN r ON c_nationkey = n_nationkey
UNION ALL SELECT n_name || '.md', a || '## S' || chr(10) || 'sec ' || f || ')' FROM r"""
)
def L5_expand_embeds(spark, sf_dir):
    return L.expand_embeds(md_links(spark, sf_dir))


@query(
    """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS g FROM customer),
s AS (SELECT k, g, CASE WHEN k % 2 = 0 THEN 'S' || k || '|' ELSE 'L|' END AS a, CASE WHEN k % 2 = 0 THEN 'more' ELSE 'all' END AS b FROM c)
SELECT 'c/' || k || '.md' AS path, 'A ' || a || chr(10) || b || ' B {{IMAGE:c/pic.png}} C [not found: lost] D G ' || g || ' E ![v](http://x/y.md)' || chr(10) || '| ' || replace(a, '|', '\\|') || '<br>' || b || ' | z |' AS text FROM s
UNION ALL SELECT 'c/' || k || '/side.md', a || chr(10) || b FROM s WHERE k % 2 = 0
UNION ALL SELECT 'lib/side.md', 'L|' || chr(10) || 'all'
UNION ALL SELECT DISTINCT 'c/seg/' || g || '.md', 'G ' || g FROM c"""
)
def L5_embeds_by_path(spark, sf_dir):
    """A note for each customer embeds a note of a folder of its own name, else of the library, an image, a lost note, its segment's note by path, an address, and the first once more in a table."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    even = F.col("c_custkey") % 2 == 0
    notes = c.select(cat("c/", k, ".md").alias("path"), cat("A ![[side]] B ![t](pic.png =3x) C ![[lost]] D ![u](seg/", F.col("c_mktsegment"), ".md) E ![v](http://x/y.md)\n| ![[side]] | z |").alias("text"))
    sides = c.filter(even).select(cat("c/", k, "/side.md").alias("path"), cat("---\na: b\n---\n", "S", k, "|\nmore").alias("text"))
    segments = c.select("c_mktsegment").distinct().select(cat("c/seg/", F.col("c_mktsegment"), ".md").alias("path"), cat("G ", F.col("c_mktsegment")).alias("text"))
    library = spark.createDataFrame([("lib/side.md", "L|\nall")], "path string, text string")
    docs = notes.unionByName(sides).unionByName(segments).unionByName(library)
    found = L.expand_embeds(docs, search_dirs=("lib",), assets=spark.createDataFrame([("c/pic.png",)], "path string"), images="placeholder")
    return found.withColumn("text", F.regexp_replace("text", r"\A---\na: b\n---\n", ""))


@query(
    """WITH d AS (SELECT c_custkey, c_nationkey, replace(c_name, '#', '-') AS c_name FROM customer),
f AS (SELECT c_nationkey AS k, min(c_custkey) AS f, count(*) AS c FROM d GROUP BY ALL)
SELECT c_name || '.md' AS node, 2 AS out_degree, CASE WHEN f = c_custkey THEN 2 ELSE 1 END AS in_degree, 1 AS broken FROM d JOIN f ON k = c_nationkey
UNION ALL SELECT n_name || '.md', 1, c, 0 FROM nation JOIN f ON k = n_nationkey"""
)
def L6_link_graph(spark, sf_dir):
    docs = md_links(spark, sf_dir)
    found = L.extract_links(docs).filter("kind = 'wiki_embed'").select(F.col("path").alias("source_path"), "pos", L.parse_target(F.col("link"))["path"].alias("target"))
    edges = found.join(sorted_side(L.resolve_links(found, docs, ["source_path", "pos"])), ["source_path", "pos"])
    return L.link_graph(edges.select(F.col("source_path").alias("source"), F.col("resolved").alias("target")), docs.select(F.col("path").alias("node")))


RING = "(2 + (c_custkey // 60) % 4)"


@query(
    f"""WITH c AS (SELECT c_custkey AS k, {RING} AS s FROM customer),
e AS (SELECT k AS a, k // 60 * 60 + (k % 60) // s * s + ((k % 60) % s + 1) % s AS b FROM c WHERE k % 60 < 60 // s * s),
e2 AS (SELECT a, b FROM e JOIN c ON c.k = b)
SELECT DISTINCT x.a || '.md' AS node, CASE WHEN z.b IS NOT NULL AND y.b = x.a THEN 2 WHEN z.b = x.a THEN 3 ELSE 4 END AS length
FROM e2 x JOIN e2 y ON y.a = x.b LEFT JOIN e2 z ON z.a = y.b LEFT JOIN e2 w ON w.a = z.b WHERE y.b = x.a OR z.b = x.a OR w.b = x.a"""
)
def L6_link_cycles(spark, sf_dir):
    """A note for each customer, in rings of two to five notes of which each links to the next; rings of five are too long, and rings with customers missing are open."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, (2 + F.floor(k / 60) % 4).alias("s"), F.floor(k / 60).alias("b"), (k % 60).alias("i"))
    following = F.col("b") * 60 + F.floor(F.col("i") / F.col("s")) * F.col("s") + (F.col("i") % F.col("s") + 1) % F.col("s")
    text = cat("to [[", following.cast("bigint").cast("string"), "#part]] and [[none]]")
    docs = rows.select(cat(k.cast("string"), ".md").alias("path"), text.alias("text"))
    found = L.extract_links(docs).filter("kind = 'wiki_link'").select(F.col("path").alias("source_path"), "pos", L.parse_target(F.col("link"))["path"].alias("target"))
    edges = found.join(sorted_side(L.resolve_links(found, docs, ["source_path", "pos"])), ["source_path", "pos"])
    return L.link_cycles(edges.select(F.col("source_path").alias("source"), F.col("resolved").alias("target")), max_depth=4)
