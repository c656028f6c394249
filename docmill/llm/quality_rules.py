"""Quality rules with risk-controlled thresholds.

Every rule compares one share of a document (symbols per word, repeated lines
per line, ...) with a cutoff. Cutoffs are not guessed: on labelled documents,
for each stratum, all rules together go down one fixed path (the same cutoff of
a grid for all of them, from the highest), and at each step an exact binomial
test asks whether they would jointly reject more than ``risk`` of the good
documents. The path ends before the first step whose test is not rejected at
``error`` / strata, which is fixed-sequence testing: steps of one path need no
correction among each other. So with probability 1 - ``error``, in no stratum
do the cutoffs where the path ends, nor any higher ones, reject more than
``risk`` of its good documents. Each rule then takes the lowest cutoff not below
that end where it rejects at least as many labelled bad documents as good ones.

A stratum with too few labels for any step uses the cutoffs of the pool of all
labelled documents, which counts as one stratum more; the risk then holds for
the pool, not for that stratum alone. Only where even the pool has too few
labels do the rules reject nothing.

Everything runs on built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.text import BLANK_CLASS, words
from docmill.storage import materialise

#: Most good documents of a stratum that may be rejected, and the chance that this fails anywhere.
RISK, ERROR = 0.05, 0.05
#: Cutoffs tried for every share.
GRID = [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: Documents with fewer words, or more repeated words in a hundred, fail whatever the labels say.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Strata up to which their cutoffs are broadcast.
MAX_BROADCAST_STRATA = 10_000


def repeated_words(w: Column) -> Column:
    """How many words lie in a three-word window that the array holds at least twice.

    Windows are first sorted by the high bits of a hash with their position in
    the low bits; those that share the high bits with a neighbour are then
    compared as texts, so the count is exact.
    """
    n = F.size(w)

    def once(value: Column, f) -> Column:
        """``f`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def hashes(room: Column) -> Column:
        """``room`` is a power of two above every position."""
        keep = F.bitwise_not(room - 1)
        return F.sort_array(
            F.transform(
                F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(keep).bitwiseOR(i.cast("bigint")),
            )
        )

    def alike(x: Column, y: Column, room: Column) -> Column:
        return F.coalesce(x.bitwiseXOR(y).between(F.lit(0), room - 1), F.lit(False))

    def texts(o: Column, room: Column) -> Column:
        near = F.filter(o, lambda x, i: alike(x, F.get(o, i + 1), room) | ((i > 0) & alike(x, F.get(o, i - 1), room)))

        def text(x: Column) -> Column:
            p = x.bitwiseAND(room - 1).cast("int")
            return F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("t"), p.alias("p"))

        return F.array_sort(F.transform(near, text))

    def same(s: Column) -> Column:
        found = F.filter(s, lambda x, i: (x["t"] == F.get(s, i + 1)["t"]) | ((i > 0) & (x["t"] == F.get(s, i - 1)["t"])))
        return F.sort_array(F.transform(found, lambda x: x["p"]))

    def covered(s: Column) -> Column:
        gaps = F.transform(s, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(s, i + 1) - p), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(o: Column, room: Column) -> Column:
        any_alike = F.size(F.filter(o, lambda x, i: alike(x, F.get(o, i + 1), room))) > 0
        return F.when(any_alike, once(texts(o, room), lambda t: once(same(t), covered))).otherwise(F.lit(0).cast("bigint"))

    room = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ceil(F.log2((n + 2).cast("double"))).cast("int"))
    return once(room, lambda r: once(hashes(r), lambda o: count(o, r)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", keep_row: bool = False) -> DataFrame:
    """The counts of every document's whole text, one row per row of ``docs``; null text has no words."""
    text = F.coalesce(docs[text_col], F.lit(""))
    stratum = F.coalesce(docs[stratum_col].cast("string"), F.lit("")) if stratum_col else F.lit("")
    rows = docs.select(docs[id_col].alias("doc_id"), stratum.alias("stratum"), text.alias("text"), *([F.struct("*").alias("row")] if keep_row else []))
    rows = rows.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    bare = F.array_join("w", "")
    return rows.select(
        "doc_id",
        "stratum",
        F.size("w").cast("bigint").alias("n_words"),
        F.char_length(bare).cast("bigint").alias("word_chars"),
        F.regexp_count(F.col("text"), F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        (F.char_length(bare) - F.char_length(F.regexp_replace(bare, r"\p{Lu}", ""))).cast("bigint").alias("n_upper"),
        F.regexp_count(F.col("text"), F.lit(rf"!(?={BLANK_CLASS}|$)")).cast("bigint").alias("n_shouts"),
        *(["row"] if keep_row else []),
    )


def shares() -> dict[str, Column]:
    """The rules by name: the share of a document that a cutoff bounds."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.least(F.col("n_symbols") / n, F.lit(1.0)),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated": F.col("n_repeat_words") / n,
        "upper": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "shouts": F.least(F.col("n_shouts") / n, F.lit(1.0)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def binomial_tail(n: Column, x: Column, p: Column) -> Column:
    """P(X <= x) for X of Binomial(n, p), as an exact sum in logarithms; 1 where x is not below the mean."""
    odds = F.log(p) - F.log(1 - p)
    start = F.struct((n * F.log(1 - p)).alias("term"), (n * F.log(1 - p)).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log((n - k + 1) / k) + odds
        big = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (big + F.log(F.exp(acc["sum"] - big) + F.exp(term - big))).alias("sum"))

    ks = F.when(x >= 1, F.sequence(F.lit(1).cast("bigint"), x.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(x >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(ks, start, step, lambda acc: acc["sum"])))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum, bounds``: the cutoff of each rule that has one, as a map.

    One row for every stratum with enough labels for a test, the map empty if
    none succeeds, and one of null ``stratum`` for the pool. ``labels`` has
    ``doc_id`` and ``quality``; rows with null in either, and documents that fail
    the base rules, say nothing. A document with several labels is good if its
    lowest label is 1.
    """
    rules = shares()
    verdicts = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = measured.filter(~base_failed()).join(verdicts.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    # A level is how many cutoffs of the grid a share exceeds; the joint one is that of the worst rule.
    levels = {k: sum(((v > t).cast("int") for t in GRID), F.lit(0)) for k, v in rules.items()}
    known = known.select("stratum", "good", *(v.alias(k) for k, v in levels.items())).withColumn("joint", F.greatest(*rules))
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("level")) for k in [*rules, "joint"])))
    counts = known.select("stratum", "good", cells.alias("c")).groupBy("stratum", "good", "c.rule", "c.level").agg(F.count(F.lit(1)).alias("n"))
    pool = counts.withColumn("stratum", F.lit(None).cast("string")).groupBy("stratum", "good", "rule", "level").agg(F.sum("n").alias("n"))
    steps = F.explode(F.array(*(F.struct(F.lit(j).alias("step"), F.lit(t).alias("cutoff")) for j, t in enumerate(GRID))))
    over = F.col("level") > F.col("s.step")
    exceed = counts.unionByName(pool).withColumn("s", steps).groupBy("stratum", "rule", "s.step", "s.cutoff").agg(
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("good") & over, F.col("n")).otherwise(0)).alias("good_over"),
        F.sum(F.when(~F.col("good") & over, F.col("n")).otherwise(0)).alias("bad_over"),
    )
    exceed = materialise(exceed)
    tests = exceed.filter("rule = 'joint' AND n_good > 0")
    tests = tests.crossJoin(F.broadcast(tests.agg((F.count(F.lit(1)) / len(GRID)).alias("strata"))))
    level = F.lit(error) / F.col("strata")
    # Enough labels: a step without any exceedance would be certified.
    tests = tests.filter(F.pow(F.lit(1 - risk), F.col("n_good")) <= level)
    down = Window.partitionBy("stratum").orderBy(F.desc("step"))
    tests = tests.withColumn("sure", F.min(binomial_tail(F.col("n_good"), F.col("good_over"), F.lit(risk)) <= level).over(down))
    ends = tests.groupBy("stratum").agg(F.min(F.when(F.col("sure"), F.col("step"))).alias("end"))
    own = exceed.filter("rule <> 'joint' AND good_over <= bad_over").select(F.col("stratum").alias("of"), "rule", "step", "cutoff")
    chosen = ends.join(own, ends["stratum"].eqNullSafe(own["of"]) & (F.col("step") >= F.col("end")), "left").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    entries = F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("rule", "cutoff")))
    return chosen.groupBy("stratum").agg(F.map_from_entries(entries).alias("bounds"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", keep_row: bool = False) -> DataFrame:
    """Measure and judge every row of ``docs``.

    Returns ``doc_id``, the counts, ``base_failed`` and ``kept``; with
    ``keep_row`` the input row as ``row``. Null and empty texts have no words
    and fail the base rules. A null stratum is a stratum of its own. Repeated
    ids are judged row by row. Without labels only the base rules reject.
    """
    # Measured once; where whole rows are kept, they are written along and only the last step reads them.
    measured = materialise(measures(docs, id_col, text_col, stratum_col, keep_row))
    # One row per stratum with enough labels, of a map of at most five entries, and the pool's.
    bounds = materialise(certified_cutoffs(measured.drop("row"), labels))
    own = bounds.filter("stratum IS NOT NULL").withColumnRenamed("stratum", "of")
    # So few strata are a small table; a stratum may hold most rows, so these stay where they are.
    own = F.broadcast(own) if own.count() <= MAX_BROADCAST_STRATA else own
    pool = bounds.filter("stratum IS NULL").agg(F.first("bounds").alias("pooled"))
    rejects = F.lit(False)
    for k, v in shares().items():
        rejects = rejects | F.coalesce(v > F.coalesce("bounds", "pooled")[k], F.lit(False))
    judged = measured.join(own, F.col("stratum") == F.col("of"), "left").crossJoin(F.broadcast(pool))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        F.when(base_failed(), False).otherwise(~rejects).alias("kept"),
        *(["row"] if keep_row else []),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """``docs`` without the rows that :func:`judge` rejects; same columns."""
    return judge(docs, labels, id_col, text_col, stratum_col, keep_row=True).filter("kept").select("row.*")
