"""Proofreading a corpus with dictionaries; every operator is map-only but the summary and those over large dictionaries, which are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import bound, owned, piece, scan, wide
from docmill.operators.filters import possibly_in
from docmill.operators.lines import doc_lines
from docmill.storage import materialise

# The default symbol pairs and the full-width digits with their corrections.
PAIRS = [("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"), ("{", "}"), ("「", "」"), ("'", "'"), ('"', '"'), ("‘", "’"), ("“", "”"), ("《", "》")]
SYMBOLS = {h: [f] for h, f in zip("0123456789", "０１２３４５６７８９", strict=True)}
RULES = ("typo", "symbol", "pairing", "sensitive")
HIT = ["start_pos", "end_pos", "error_text", "suggestion", "error_type", "source"]


def split_paragraphs(docs: DataFrame, text_col: str = "text", skip_code: bool = True, skip_quotes: bool = False) -> DataFrame:
    """One row per non-blank line with ``para_no`` (line from 0) and ``para``; fenced code is skipped by the parity of fences before a line."""
    others = [c for c in docs.columns if c != text_col]
    lines = doc_lines(docs.select(*others, F.regexp_replace(text_col, "\r\n?", "\n").alias(text_col)), text_col, r"[^\S\n]*(?:```|~~~)")
    rows = lines.select(*others, F.col("line_no").alias("para_no"), F.col("line").alias("para"), "in_code").filter(F.col("para").rlike(r"(?U)\S"))
    if skip_code:
        rows = rows.filter(~F.col("in_code"))
    if skip_quotes:
        rows = rows.filter(~F.col("para").rlike(r"^\s*>"))
    return rows.drop("in_code")


#: First signs of a dictionary's words by which a text's words are looked up.
GRAM = 6
#: Words of a dictionary that is given to every task; larger ones are joined by their grams.
BROADCAST_WORDS = 200_000

ENTRY = "struct<wrong:string,correct:string>"
WORD = "struct<w:string,ex:array<string>,reach:int>"


def _entries(dictionary: dict[str, list[str]]) -> Column:
    pairs = [(wrong, right) for right, wrongs in dictionary.items() for wrong in wrongs if wrong]
    return F.array(*(F.struct(F.lit(w).alias("wrong"), F.lit(c).alias("correct")) for w, c in pairs)) if pairs else F.array().cast(f"array<{ENTRY}>")


def dictionary_frame(spark: SparkSession, dictionary: dict[str, list[str]]) -> DataFrame:
    """``wrong, correct`` of a dictionary ``correct -> [wrong, ...]``, for :func:`find_typos` and :func:`find_wrong_symbols` over large ones."""
    return spark.createDataFrame([(w, c) for c, ws in dictionary.items() for w in ws], "wrong string, correct string")


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of so many signs of a text."""

    def of_signs(cs: Column) -> Column:
        def of_size(n: int) -> Column:
            return F.transform(cs, lambda c, i: F.concat(c, *(F.get(cs, i + k) for k in range(1, n))))

        runs = [of_size(n) for n in sizes]
        return F.array_distinct(F.filter(F.concat(*runs), lambda g: g.isNotNull() & (g != "")))

    return bound(F.split(text, "", -1), of_signs)


def _looked_up(paras: DataFrame, entries: DataFrame, word: Column, fold, keys: list[str], para: str) -> DataFrame:
    """``paras`` whose text holds the gram of an entry, with these in ``_there`` (array of the ``_e`` of ``entries``).

    The words' first signs are an index that the texts' runs of signs are joined with, so that time hardly grows with the
    dictionary. Only ``keys`` and grams travel; ``keys`` name paragraphs, and repeated ones share what is found and then verified.
    """
    index = entries.filter(word != "").select(F.substring(fold(word), 1, GRAM).alias("_gram"), "_e").withColumn("_size", F.char_length("_gram"))
    sizes, words = [r["_size"] for r in index.select("_size").distinct().collect()], index.count()
    if not sizes:
        return paras.filter(F.lit(False)).withColumn("_there", F.array().cast(f"array<{entries.schema['_e'].dataType.simpleString()}>"))
    if words <= BROADCAST_WORDS:
        index = F.broadcast(index)
    spread = paras.select(*keys, F.explode(_grams(fold(F.col(para)), sorted(sizes))).alias("_gram"))
    met = spread.join(index, "_gram").groupBy(*keys).agg(F.array_sort(F.collect_set("_e")).alias("_there"))
    named = met.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_there")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & paras[k].eqNullSafe(F.col(f"_k{i}"))
    return paras.join(named, on).select(*paras.columns, "_there")


def starts_of(parts: Column, size: Column) -> Column:
    """0-based starts of the separators (of ``size`` characters) between the parts of a split text."""
    ends = scan(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(0), lambda a, x: a + F.char_length(x) + size, "int")
    return F.transform(ends, lambda e: e - size)


def _met_words(paras: DataFrame, words: DataFrame, para: str) -> DataFrame:
    """All columns but the text, ``_word, start_pos``: non-overlapping occurrences of the ``wrong`` of ``words``, a written table of distinct ones.

    A text's runs of signs meet the words' first signs, which tell the lengths of words that may begin there; the text's
    own pieces of these lengths pass a filter of the words. No exchange, and hardly a piece is left that is no word. From more
    than :data:`BROADCAST_WORDS` distinct first signs on they are a filter too, and all lengths are tried.
    """
    others = [c for c in paras.columns if c != para]
    # All in UTF-32, where a slice costs what it holds, wherever it lies.
    # Only a word that ends as it begins may overlap itself.
    ends_as_begun = lambda x: x.rlike(r"(?s)\A(.+).*\1\z")
    known = words.select(wide(F.col("wrong")).alias("_w"), ends_as_begun(F.col("wrong")).alias("_round")).withColumn("_n", (F.octet_length("_w") / 4).cast("int"))
    gram = lambda w, at, size: F.substring(w, at * 4 + 1, size * 4)
    sign = known.withColumn("_size", F.least("_n", F.lit(GRAM))).withColumn("_h", F.xxhash64(gram(F.col("_w"), F.lit(0), F.col("_size"))))
    signs = materialise(sign.groupBy("_h").agg(F.collect_set("_n").alias("_lengths"), F.collect_set("_size").alias("_sizes"), F.max("_round").alias("_round")))
    told = signs.agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("_lengths"))).alias("lengths"), F.array_distinct(F.flatten(F.collect_set("_sizes"))).alias("sizes")).first()
    sizes, lengths = sorted(told["sizes"]), sorted(told["lengths"])
    if not sizes:
        return paras.select(*others, F.lit("").alias("_word"), F.lit(0).alias("start_pos")).filter(F.lit(False))
    texts = paras.select(*others, para, wide(F.col(para)).alias("_wide")).withColumn("_signs", (F.octet_length("_wide") / 4).cast("int")).filter(F.col("_signs") >= sizes[0])
    placed = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("_signs") - sizes[0])).alias("_at"))
    placed = placed.withColumn("_run", F.explode(F.array(*map(F.lit, sizes)))) if sizes[1:] else placed.withColumn("_run", F.lit(sizes[0]))
    placed = placed.filter(F.col("_at") + F.col("_run") <= F.col("_signs")).withColumn("_gram", F.xxhash64(gram(F.col("_wide"), F.col("_at"), F.col("_run"))))
    # Words of at least GRAM signs begin with a run of GRAM, shorter ones are their run.
    if told["n"] <= BROADCAST_WORDS:
        placed = placed.join(F.broadcast(signs.select("_h", "_lengths", "_round")), F.col("_gram") == F.col("_h"))
    else:
        placed = possibly_in(placed, F.col("_gram"), signs, F.col("_h")).withColumns({"_lengths": F.array(*map(F.lit, lengths)), "_round": F.lit(True)})
    placed = placed.select(*others, para, "_wide", "_signs", "_at", "_run", "_round", F.explode("_lengths").alias("_n"))
    fits = F.when(F.col("_run") < GRAM, F.col("_n") == F.col("_run")).otherwise(F.col("_n") >= GRAM)
    pieces = placed.filter(fits & (F.col("_at") + F.col("_n") <= F.col("_signs"))).withColumn("_piece", gram(F.col("_wide"), F.col("_at"), F.col("_n")))
    pieces = possibly_in(pieces, F.xxhash64("_piece"), known, F.xxhash64("_w"), marks=2)
    pieces = pieces.select(*others, para, "_at", "_n", "_round", piece(F.col("_piece"), F.lit(0), F.col("_n")).alias("_word"))
    # Of such a word the first occurrence stands for all; no other hit carries the text.
    first = F.call_function("instr", F.col(para), F.col("_word")) == F.col("_at") + 1
    pieces = pieces.withColumn("_own", F.when(F.col("_round") & ends_as_begun(F.col("_word")), F.when(first, F.col(para)).otherwise("")))
    pieces = pieces.select(*others, "_at", "_n", "_word", "_own")
    cut = F.split("_own", F.concat(F.lit(r"\Q"), F.col("_word"), F.lit(r"\E")), -1)
    starts = F.when(F.col("_own").isNull(), F.array("_at")).otherwise(bound(cut, lambda p: starts_of(p, F.col("_n"))))
    return pieces.select(*others, "_word", F.explode(starts).alias("start_pos"))


def _find(paras: DataFrame, dictionary: dict[str, list[str]] | DataFrame, para: str, error_type: str, source: str) -> DataFrame:
    others = [c for c in paras.columns if c != para]
    if isinstance(dictionary, DataFrame):
        entries = materialise(dictionary.filter("wrong <> ''").select("wrong", "correct").distinct())
        words = materialise(entries.select("wrong").distinct())
        entries = entries.select(F.col("wrong").alias("_wrong"), F.struct("wrong", "correct").alias("_e"))
        entries = F.broadcast(entries) if entries.count() <= BROADCAST_WORDS else entries.hint("shuffle_hash")
        found = _met_words(paras, words, para).join(entries, F.col("_word") == F.col("_wrong")).select(*others, "_e", "start_pos")
    else:
        there = F.filter(_entries(dictionary), lambda e: F.contains(F.col(para), e["wrong"]))
        found = paras.select(*others, para, F.explode(there).alias("_e"))
        parts = F.split(F.col(para), F.concat(F.lit(r"\Q"), F.col("_e.wrong"), F.lit(r"\E")), -1)
        found = found.select(*others, "_e", F.explode(bound(parts, lambda p: starts_of(p, F.char_length(F.col("_e.wrong"))))).alias("start_pos"))
    return found.select(
        *others,
        "start_pos",
        (F.col("start_pos") + F.char_length("_e.wrong")).alias("end_pos"),
        F.col("_e.wrong").alias("error_text"),
        F.col("_e.correct").alias("suggestion"),
        F.lit(error_type).alias("error_type"),
        F.lit(source).alias("source"),
    )


def find_typos(paras: DataFrame, typos: dict[str, list[str]] | DataFrame, para: str = "para", keys: list[str] | None = None) -> DataFrame:
    """Every non-overlapping occurrence of each wrong form (``correct -> [wrong, ...]``).

    A dictionary of up to some hundred words is part of the expression, map-only. A larger one comes as a table
    ``wrong, correct`` and is met by the first signs of its words; each row is found by itself, so ``keys`` may be left out.
    """
    return _find(paras, typos, para, "typo", "typo")


def find_wrong_symbols(paras: DataFrame, symbols: dict[str, list[str]] | DataFrame = SYMBOLS, para: str = "para", keys: list[str] | None = None) -> DataFrame:
    """As :func:`find_typos`, for signs."""
    return _find(paras, symbols, para, "punctuation", "symbol")


def find_unpaired_symbols(paras: DataFrame, pairs: list[tuple[str, str]] = PAIRS, para: str = "para") -> DataFrame:
    """Closers without opener and openers without closer, for each pair by itself; where both are one sign, every one counts as opener.

    A closer has none where no opener is open from the left, an opener where no closer is from the right: two counts, no stack.
    """
    others = [c for c in paras.columns if c != para]
    chars = "".join(sorted({c for p in pairs for c in p}))
    some = paras.filter(F.translate(F.col(para), chars, "") != F.col(para))
    types = F.array(*(F.struct(F.lit(a).alias("o"), F.lit(b).alias("c")) for a, b in pairs))
    some = some.select(*others, para, F.explode(F.filter(types, lambda t: F.contains(F.col(para), t["o"]) | F.contains(F.col(para), t["c"]))).alias("_t"))
    signs = F.filter(
        F.transform(F.split(F.col(para), "", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["x"] == F.col("_t.o")) | (s["x"] == F.col("_t.c"))
    )
    opens = lambda s: s["x"] == F.col("_t.o")

    def alone(xs: Column, other) -> Column:
        """Signs that meet no open sign of the other kind, which is not theirs to open."""
        start = F.struct(F.lit(0).alias("open"), F.lit(-1).alias("alone"))

        def step(a: Column, s: Column) -> Column:
            return F.struct(
                F.when(other(s), a["open"] + 1).otherwise(F.greatest(a["open"] - 1, F.lit(0))).alias("open"), F.when(~other(s) & (a["open"] == 0), s["i"]).otherwise(F.lit(-1)).alias("alone")
            )

        marked = F.zip_with(xs, scan(xs, start, step, "struct<open:int,alone:int>"), lambda s, a: F.when(a["alone"] >= 0, s))
        return F.filter(marked, lambda s: s.isNotNull())

    left = bound(signs, lambda xs: F.concat(alone(xs, opens), alone(F.reverse(xs), lambda s: ~opens(s))))
    found = some.select(*others, F.explode(left).alias("_s"))
    return found.select(
        *others,
        F.col("_s.i").alias("start_pos"),
        (F.col("_s.i") + 1).alias("end_pos"),
        F.col("_s.x").alias("error_text"),
        F.lit("").alias("suggestion"),
        F.lit("unmatched").alias("error_type"),
        F.lit("pairing").alias("source"),
    )


def find_sensitive(paras: DataFrame, words: dict[str, list[str]] | DataFrame, para: str = "para", keys: list[str] | None = None) -> DataFrame:
    """Hits of each word in any case, unless the hit lies in the first place of an exception phrase near it.

    Large dictionaries come as a table ``word, exceptions``, as in :func:`find_typos`.
    """
    others = [c for c in paras.columns if c != para]
    if isinstance(words, DataFrame):
        own = F.filter(F.coalesce("exceptions", F.array().cast("array<string>")), lambda x: (x != "") & F.contains(x, F.col("word")))
        entries = words.filter("word IS NOT NULL").select(F.col("word").alias("w"), own.alias("ex"))
        entries = entries.select(F.struct("w", "ex", F.coalesce(F.array_max(F.transform("ex", F.char_length)), F.lit(0)).alias("reach")).alias("_e"))
        paras, known = _looked_up(paras, entries, F.col("_e.w"), F.lower, keys or others, para), F.col("_there")
    else:
        kept = [(w, [x for x in ex if x and w in x]) for w, ex in words.items() if w]
        known = F.array().cast(f"array<{WORD}>")
        if kept:
            known = F.array(
                *(F.struct(F.lit(w).alias("w"), F.array(*map(F.lit, ex)).cast("array<string>").alias("ex"), F.lit(max(map(len, ex), default=0)).alias("reach")) for w, ex in kept)
            )
    there = F.filter(known, lambda e: F.contains(F.lower(F.col(para)), F.lower(e["w"])))
    # A context is a slice of the text in UTF-32, and all is worked out before hits become rows, so that none carries the text.
    found = paras.select(*others, para, wide(F.col(para)).alias("_wide"), F.explode(there).alias("_e"))
    size = F.char_length("_e.w")

    def hits(start: Column, text: Column) -> Column:
        begin = F.greatest(F.lit(0), start - F.col("_e.reach"))
        context = piece(F.col("_wide"), begin, start + size + F.col("_e.reach") - begin)

        def spares(x: Column, c: Column) -> Column:
            at = F.call_function("locate", x, c)
            first = begin + at - 1
            return (at > 0) & (first <= start) & (start + size <= first + F.char_length(x))

        spared = F.when(F.col("_e.reach") == 0, F.lit(False)).otherwise(bound(context, lambda c: F.exists("_e.ex", lambda x: spares(x, c))))
        return F.struct(start.alias("start_pos"), text.alias("error_text"), spared.alias("spared"))

    quoted = F.concat(F.lit(r"(?iu)\Q"), F.col("_e.w"), F.lit(r"\E"))
    starts = bound(F.split(F.col(para), quoted, -1), lambda p: starts_of(p, size))
    all_hits = F.zip_with(starts, F.regexp_extract_all(F.col(para), quoted, F.lit(0)), hits)
    found = found.select(*others, size.alias("_size"), F.explode(F.filter(all_hits, lambda h: ~h["spared"])).alias("_h"))
    return found.select(
        *others,
        F.col("_h.start_pos").alias("start_pos"),
        (F.col("_h.start_pos") + F.col("_size")).alias("end_pos"),
        F.col("_h.error_text").alias("error_text"),
        F.lit("").alias("suggestion"),
        F.lit("sensitive").alias("error_type"),
        F.lit("sensitive").alias("source"),
    )


def proofread(paras: DataFrame, typos: dict, symbols: dict, pairs: list, words: dict, options: dict[str, bool] | None = None, para: str = "para") -> DataFrame:
    """All hits of the enabled rules with ``rule_order``; rules that ``options`` doesn't name are on."""
    made = {
        "typo": lambda: find_typos(paras, typos, para),
        "symbol": lambda: find_wrong_symbols(paras, symbols, para),
        "pairing": lambda: find_unpaired_symbols(paras, pairs, para),
        "sensitive": lambda: find_sensitive(paras, words, para),
    }
    on = [r for r in RULES if (options or {}).get(r, True)]
    if not on:
        return _find(paras, {}, para, "", "").withColumn("rule_order", F.lit(0))
    parts = [made[r]().withColumn("rule_order", F.lit(RULES.index(r))) for r in on]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def proofread_summary(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, source, hits``: counts for each document and rule, for each document (source null), and zero for documents without hits."""
    counted = hits.groupBy(id_col, "source").agg(F.count(F.lit(1)).alias("hits"))
    whole = counted.groupBy(id_col).agg(F.sum("hits").alias("hits")).withColumn("source", F.lit(None).cast("string"))
    found = counted.unionByName(whole)
    return docs.select(id_col).distinct().join(found, id_col, "left").select(id_col, "source", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


def proofread_totals(hits: DataFrame, id_col: str = "doc_id", para_col: str = "para_no") -> DataFrame:
    """``level, doc_id, para_no, source, hits``: counts for each paragraph, document and the corpus (``level``), by rule and, with null ``source``, of all rules. One exchange."""
    sets = [[id_col, para_col, "source"], [id_col, para_col], [id_col, "source"], [id_col], ["source"], []]
    counted = hits.groupingSets([[F.col(c) for c in s] for s in sets], id_col, para_col, "source")
    level = F.when(F.grouping(para_col) == 0, "paragraph").when(F.grouping(id_col) == 0, "document").otherwise("corpus")
    return counted.agg(F.count(F.lit(1)).alias("hits"), level.alias("level")).select("level", id_col, para_col, "source", "hits")


def check_dictionary(words: DataFrame) -> DataFrame:
    """``word, exception`` where the exception (of array ``exceptions``) doesn't contain its word."""
    return words.select("word", F.explode("exceptions").alias("exception")).filter(~F.contains("exception", "word"))


def segment_hits(paras: DataFrame, hits: DataFrame, keys: list[str], para: str = "para") -> DataFrame:
    """Each paragraph cut at every start and end of a hit: ``seg_no, start_pos, end_pos, segment`` and the first hit's ``source`` that covers it, else null.

    A sweep: edges in order, and the ranks of the hits that are open there.
    Hits of one place and rule count by their text and source.
    """
    order = F.struct("rule_order", "start_pos", "end_pos", "error_text", "source")
    grouped = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_hits"))
    rows = paras.join(grouped, keys, "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(grouped.schema["_hits"].dataType)))
    edge = "struct<p:int,opens:boolean,rank:int>"
    none = F.array().cast(f"array<{edge}>")

    def edges(hs: Column) -> Column:
        """Where hits begin and end, and the text itself, which is no hit, around them."""
        at = lambda p, opens, rank: F.struct(p.cast("int").alias("p"), F.lit(opens).alias("opens"), rank.cast("int").alias("rank"))
        # A hit without extent covers nothing.
        ends = F.flatten(F.transform(hs, lambda h, k: F.when(h["start_pos"] < h["end_pos"], F.array(at(h["start_pos"], True, k), at(h["end_pos"], False, k))).otherwise(F.array(at(h["start_pos"], True, F.lit(None))))))
        return F.array_sort(F.concat(none, F.array(at(F.lit(0), True, F.lit(None)), at(F.char_length(para), True, F.lit(None))), ends))

    def places(es: Column) -> Column:
        """One entry for each place: its edges."""
        return F.transform(owned(F.transform(es, lambda e, k: (k > 0) & (e["p"] == F.get(es, k - 1)["p"]))), lambda r: F.slice(es, r["at"] + 1, r["until"] - r["at"]))

    def swept(ps: Column) -> Column:
        """After each place, the ranks of the open hits."""

        def step(now: Column, place: Column) -> Column:
            own = F.filter(place, lambda e: e["rank"].isNotNull())
            closed = F.transform(F.filter(own, lambda e: ~e["opens"]), lambda e: e["rank"])
            opened = F.transform(F.filter(own, lambda e: e["opens"]), lambda e: e["rank"])
            return F.array_except(F.concat(now, opened), closed)

        return scan(ps, F.array().cast("array<int>"), step, "array<int>")

    placed = rows.withColumn("_p", bound(bound(F.col("_hits"), edges), places)).withColumn("_open", F.transform(swept(F.col("_p")), F.array_min))
    def cuts(w: Column) -> Column:
        def cut(place: Column, i: Column) -> Column:
            a, b = F.get(place, F.lit(0))["p"], F.get(F.get(F.col("_p"), i + 1), F.lit(0))["p"]
            segment = piece(w, a, b - a)
            return F.struct(a.alias("a"), b.alias("b"), segment.alias("t"), F.get(F.col("_hits"), F.get(F.col("_open"), i))["source"].alias("source"))

        return F.transform(F.slice("_p", F.lit(1), F.size("_p") - 1), cut)

    cut = placed.select(*keys, F.posexplode(bound(wide(F.col(para)), cuts)).alias("seg_no", "_c"))
    return cut.select(*keys, "seg_no", F.col("_c.a").alias("start_pos"), F.col("_c.b").alias("end_pos"), F.col("_c.t").alias("segment"), F.col("_c.source").alias("source"))
