"""Proofreading queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import proof

TYPOS = {"this": ["thsi", "thth"], "and": ["nad", "annd"], "der": ["derd"]}
SYMBOLS = {"!": ["!!"], "$": ["$$$"], "#": ["###"]}
PAIRS = [("(", ")"), ("[", "]"), ('"', '"')]
WORDS = {"trash": ["trash###", "xtrash can", "bin"], "moron": [], "thin": ["thing", "thint"]}

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proof.split_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql_values(pairs: list[tuple]) -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, p)) + ")" for p in pairs)


PARA = """para AS (
  SELECT doc_id, i - 1 AS para_no, l[i] AS para
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
  WHERE regexp_matches(l[i], '[^\\s]')
)"""


def find_sql(dictionary: dict, kind: str, source: str, ctes: str = "") -> str:
    values = sql_values([(w, c) for c, ws in dictionary.items() for w in ws])
    return f"""
  SELECT doc_id, para_no, CAST(start_pos AS INTEGER) AS start_pos, CAST(start_pos + length(wrong) AS INTEGER) AS end_pos, wrong AS error_text, correct AS suggestion, '{kind}' AS error_type, '{source}' AS source
  FROM (SELECT doc_id, para_no, wrong, correct,
               unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(wrong))) AS start_pos
        FROM (SELECT doc_id, para_no, wrong, correct, string_split(para, wrong) AS parts FROM para, (VALUES {values}) AS d(wrong, correct) WHERE contains(para, wrong)))"""


PAIRING_SQL = f"""
  SELECT doc_id, para_no, CAST(pos AS INTEGER) AS start_pos, CAST(pos + 1 AS INTEGER) AS end_pos, x AS error_text, '' AS suggestion, 'unmatched' AS error_type, 'pairing' AS source
  FROM (
    SELECT *, min(depth) OVER (PARTITION BY doc_id, para_no, o ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low,
           min(depth) OVER (PARTITION BY doc_id, para_no, o ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later
    FROM (
      SELECT *, sum(step) OVER (PARTITION BY doc_id, para_no, o ORDER BY pos) AS depth
      FROM (
        SELECT doc_id, para_no, o, c, pos, x, CASE WHEN x = o THEN 1 ELSE -1 END AS step
        FROM (SELECT doc_id, para_no, unnest(string_split(para, '')) AS x, unnest(range(0, length(para))) AS pos FROM para) ch,
             (VALUES {sql_values(PAIRS)}) AS t(o, c) WHERE x = o OR x = c))
  ) WHERE (step = -1 AND depth < least(0, coalesce(low, 0))) OR (step = 1 AND later >= depth)"""

SENSITIVE_SQL = f"""
  SELECT doc_id, para_no, CAST(s AS INTEGER) AS start_pos, CAST(s + length(w) AS INTEGER) AS end_pos, para[s + 1:s + length(w)] AS error_text, '' AS suggestion, 'sensitive' AS error_type, 'sensitive' AS source
  FROM (
    SELECT *, greatest(0, s - reach) AS f, para[greatest(0, s - reach) + 1:s + length(w) + reach] AS ctx
    FROM (SELECT doc_id, para_no, para, w, ex, reach,
                 unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(w))) AS s
          FROM (SELECT doc_id, para_no, para, w, ex, reach, string_split(lower(para), w) AS parts
                FROM para, (VALUES {", ".join(f"('{w}', {[x for x in ex if w in x]}::VARCHAR[], {max([len(x) for x in ex if w in x] or [0])})" for w, ex in WORDS.items())}) AS d(w, ex, reach)
                WHERE contains(lower(para), w))))
  WHERE len(list_filter(ex, lambda x: strpos(ctx, x) > 0 AND f + strpos(ctx, x) - 1 <= s AND s + length(w) <= f + strpos(ctx, x) - 1 + length(x))) = 0"""

TYPO_SQL, SYMBOL_SQL = find_sql(TYPOS, "typo", "typo"), find_sql(SYMBOLS, "punctuation", "symbol")
HITS = f"""hits AS (
  SELECT *, 0 AS rule_order FROM ({TYPO_SQL}) UNION ALL SELECT *, 1 FROM ({SYMBOL_SQL}) UNION ALL SELECT *, 2 FROM ({PAIRING_SQL}) UNION ALL SELECT *, 3 FROM ({SENSITIVE_SQL})
)"""


@query(f"WITH {PARA} SELECT doc_id, CAST(para_no AS INTEGER) AS para_no, para FROM para")
def P1_split_paragraphs(spark, sf_dir):
    return paragraphs(spark, sf_dir)


@query(f"WITH {PARA} SELECT * FROM ({TYPO_SQL})")
def P2_find_typos(spark, sf_dir):
    return proof.find_typos(paragraphs(spark, sf_dir), TYPOS)


#: Of every word of the corpus of six letters and more that ends in "n", the wrong form is the word itself.
CORPUS_WORDS = """words AS (
  SELECT DISTINCT w AS wrong, upper(w) AS correct FROM (SELECT unnest(string_split_regex(text, '[^a-z]+')) AS w FROM documents) WHERE length(w) >= 6 AND w LIKE '%n'
)"""


@query(
    f"""WITH {PARA}, {CORPUS_WORDS}, places AS (
  SELECT doc_id, para_no, para, unnest(range(1, length(para) + 1)) AS i FROM para
), met AS (SELECT DISTINCT doc_id, para_no, para, wrong, correct FROM places JOIN words ON substr(para, i, 6) = substr(wrong, 1, 6) AND substr(para, i, length(wrong)) = wrong)
SELECT doc_id, CAST(para_no AS INTEGER) AS para_no, CAST(s AS INTEGER) AS start_pos, CAST(s + length(wrong) AS INTEGER) AS end_pos, wrong AS error_text, correct AS suggestion, 'typo' AS error_type, 'typo' AS source
FROM (SELECT doc_id, para_no, wrong, correct, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(wrong))) AS s
      FROM (SELECT *, string_split(para, wrong) AS parts FROM met))"""
)
def P2_find_typos_of_large_dictionary(spark, sf_dir):
    """A dictionary that grows with the corpus."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "[^a-z]+", -1)).alias("wrong")).filter("length(wrong) >= 6 AND wrong LIKE '%n'").distinct()
    return proof.find_typos(paragraphs(spark, sf_dir), words.select("wrong", F.upper("wrong").alias("correct")), keys=["doc_id", "para_no"])


@query(f"WITH {PARA} SELECT * FROM ({SYMBOL_SQL})")
def P3_find_wrong_symbols(spark, sf_dir):
    return proof.find_wrong_symbols(paragraphs(spark, sf_dir), SYMBOLS)


@query(f"WITH {PARA} SELECT * FROM ({PAIRING_SQL})")
def P4_find_unpaired_symbols(spark, sf_dir):
    return proof.find_unpaired_symbols(paragraphs(spark, sf_dir), PAIRS)


@query(f"WITH {PARA} SELECT * FROM ({SENSITIVE_SQL})")
def P5_find_sensitive(spark, sf_dir):
    return proof.find_sensitive(paragraphs(spark, sf_dir), WORDS)


def hits(spark, sf_dir):
    return proof.proofread(paragraphs(spark, sf_dir), TYPOS, SYMBOLS, PAIRS, WORDS)


@query(f"WITH {PARA}, {HITS} SELECT * FROM hits")
def P6_proofread(spark, sf_dir):
    return hits(spark, sf_dir)


@query(
    f"""WITH {PARA}, {HITS}, n AS (SELECT doc_id, source, count(*) AS hits FROM hits GROUP BY ALL UNION ALL SELECT doc_id, NULL, count(*) FROM hits GROUP BY ALL)
SELECT d.doc_id, n.source, coalesce(n.hits, 0) AS hits FROM documents d LEFT JOIN n USING (doc_id)"""
)
def P7_proofread_summary(spark, sf_dir):
    return proof.proofread_summary(spark.read.parquet(f"{sf_dir}/documents.parquet"), hits(spark, sf_dir))


@query(
    f"""WITH {PARA}, {HITS}
SELECT CASE WHEN grouping(para_no) = 0 THEN 'paragraph' WHEN grouping(doc_id) = 0 THEN 'document' ELSE 'corpus' END AS level, doc_id, CAST(para_no AS INTEGER) AS para_no, source, count(*) AS hits FROM hits
GROUP BY GROUPING SETS ((doc_id, para_no, source), (doc_id, para_no), (doc_id, source), (doc_id), (source), ())"""
)
def P7_proofread_totals(spark, sf_dir):
    return proof.proofread_totals(hits(spark, sf_dir))


@query("""SELECT source AS word, lang || source AS exception FROM documents WHERE NOT contains(lang || source, source) UNION ALL SELECT source, lang FROM documents WHERE NOT contains(lang, source)""")
def P8_check_dictionary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return proof.check_dictionary(docs.select(F.col("source").alias("word"), F.array(F.concat("lang", "source"), F.col("lang")).alias("exceptions")))


@query(
    f"""WITH {PARA}, {HITS}, e AS (
  SELECT doc_id, para_no, 0 AS p FROM para UNION SELECT doc_id, para_no, length(para) FROM para UNION SELECT doc_id, para_no, start_pos FROM hits UNION SELECT doc_id, para_no, end_pos FROM hits
), s AS (SELECT doc_id, para_no, p AS a, lead(p) OVER w AS b, row_number() OVER w - 1 AS seg_no FROM e WINDOW w AS (PARTITION BY doc_id, para_no ORDER BY p))
SELECT s.doc_id, CAST(s.para_no AS INTEGER) AS para_no, CAST(seg_no AS INTEGER) AS seg_no, CAST(a AS INTEGER) AS start_pos, CAST(b AS INTEGER) AS end_pos, any_value(para[a + 1:b]) AS segment,
       min_by(h.source, (h.rule_order, h.start_pos, h.end_pos, h.error_text, h.source)) AS source
FROM s JOIN para USING (doc_id, para_no) LEFT JOIN hits h ON h.doc_id = s.doc_id AND h.para_no = s.para_no AND h.start_pos <= a AND b <= h.end_pos
WHERE b IS NOT NULL GROUP BY ALL"""
)
def P9_segment_hits(spark, sf_dir):
    return proof.segment_hits(paragraphs(spark, sf_dir), hits(spark, sf_dir), ["doc_id", "para_no"])
