"""Near-duplicate lines by a segment-partition edit join.

A line within t edits of another holds one of the other's t + 1 segments
unchanged, near the segment's own place. Distinct lines are therefore indexed by
the segments of their length, and each line probes the substrings where a
segment of a line not longer than itself could lie (the multi-match-aware
windows of segment joins). Lines that meet are verified by a banded bit-parallel
automaton: one bit for each diagonal of the band, one word for each number of
edits. Classes are connected components of verified links.

Lines travel as two 64-bit digests and their segment keys; texts are fetched
only for lines that met another one. A key that many lines share (lines of one
template) is refined instead of joined: the equal segment is cut out, what is left
of the lines is cut into segments again, and the next equal segment becomes
part of the key, until few lines share a key or a few characters are left. There
lines meet by what stays after deletions, each linked to one line of a group only.
So no line meets more than a fixed number of others under one key. A signature
(the parity of each line's hashed letter pairs, of which an edit changes at most
four) spares most pairs the comparison of texts.

Only built-in expressions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.simhash import components
from docmill.llm.text import BLANKS, free_name, possibly_in
from docmill.storage import materialise, release

#: Edits that near-duplicate lines may differ by at most, and the characters of the shorter one that each edit needs.
EDITS, CHARS_PER_EDIT = 2, 12
#: Characters compared at once when equal ends of two lines are cut off.
BLOCK = 16
#: Index entries are counted in slots first; keys are counted only in slots with more than FEW entries, or all, where these are over a quarter.
SLOTS = 1 << 20
#: Index entries of a key up to which lines meet without signatures, and with them; a key with more is refined.
FEW, CROWD = 32, 64
#: Characters left of a line from which on the lines of a crowded key meet by what stays after deletions, and edits up to which they do.
SHORT, STARRED = 8, 2
#: Stands for a matched segment that was cut out of a line in UTF-32; no character.
HOLE = b"\xff\xff\xff\xff"
#: Letter pairs that one edit changes at most.
PAIRS_PER_EDIT = 4


def allowed_edits(length: Column, edits: int = EDITS) -> Column:
    """How many edits a line of this length may be away from a longer one."""
    return F.least(F.floor(length / CHARS_PER_EDIT).cast("int"), F.lit(edits))


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row_no, line_no, line``: every line with a word, and for every row without one a row with null ``line``."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    lines = rows.select("doc_id", "row_no", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    # Trimmed as bytes: a pattern would have every line made a string of the JVM first.
    worded = F.btrim("line", F.lit(BLANKS)) != ""
    return lines.filter(worded | (F.col("line_no") == 0)).withColumn("line", F.when(worded, F.col("line")))


def digests(line: Column) -> list[Column]:
    """Two independent hashes of 64 bits name a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def segment_keys(lines: DataFrame, edits: int = EDITS) -> tuple[DataFrame, list[str], list[str]]:
    """``lines`` with one column for each key, null where the line has none, and the names of the keys of either kind.

    The first kind are the keys of a line's own segments, which also probe
    lines of its length. The others are those of further substrings that may
    equal a segment of a line ``shorter`` by up to ``edits``. ``lines`` has the
    line in UTF-32 as ``wide``, where a substring is a slice, and its length as
    ``n``. A line of t edits is cut into t + 1 even segments, the last ones longer by
    one where it doesn't divide.
    """
    if 2 * edits > CHARS_PER_EDIT:
        raise ValueError("segments would be too short for so many edits")

    # Where the segments of every length end is worked out once for all keys of that length.
    ends: dict[str, Column] = {}
    for shorter in range(edits + 1):
        m = F.col("n") - shorter
        ends[f"t{shorter}"] = allowed_edits(m, edits)
        for i in range(edits + 1):
            end = m
            for t in range(max(i, 1), edits + 1):
                # Of t + 1 segments, the last m % (t + 1) ones are longer.
                late = i + 1 - (t + 1 - m % (t + 1))
                end = F.when(F.col(f"t{shorter}") == t, F.floor(m / (t + 1)).cast("int") * (i + 1) + F.greatest(late, F.lit(0))).otherwise(end)
            ends[f"e{shorter}_{i}"] = end
    limits = {k: v for k, v in ends.items() if k[0] == "t"}
    sized = lines.select("*", *(v.alias(k) for k, v in limits.items()))
    sized = sized.select("*", *(v.alias(k) for k, v in ends.items() if k[0] == "e"))

    kinds: dict[str, list[Column]] = {"own": [], "near": []}
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            # Of t edits at most i lie before segment i + 1 and t - i after it.
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                least = next(t for t in range(max(shorter, i, 1), edits + 1) if shorter - (t - i) <= shift <= shorter + t - i)
                start, end = F.col(f"e{shorter}_{i - 1}") if i else F.lit(0), F.col(f"e{shorter}_{i}")
                piece = F.substring("wide", 4 * (start + shift) + 1, 4 * (end - start))
                key = F.when(F.col(f"t{shorter}") >= least, F.xxhash64(F.col("n") - shorter, F.lit(i), piece))
                kinds["near" if shorter or shift else "own"].append(key)
    # Through arrays with a function of their elements, Spark computes the keys in many small methods instead of one too long for the JVM to compile.
    others = [c for c in lines.columns if c not in ("wide", "n")]
    piled = sized.select(*others, *(F.filter(F.array(*keys), lambda x: x.isNotNull()).alias(kind) for kind, keys in kinds.items()))
    names = {kind: [f"{kind}{k}" for k in range(len(keys))] for kind, keys in kinds.items()}
    return piled.select(*others, *(F.get(kind, F.lit(k)).alias(name) for kind, own in names.items() for k, name in enumerate(own))), names["own"], names["near"]


def _bound(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _equal_blocks(a: Column, b: Column) -> Column:
    """How many leading blocks of two strings are equal; whole blocks of the shorter one only."""
    blocks = F.floor(F.least(F.char_length(a), F.char_length(b)) / BLOCK).cast("int")
    ks = F.when(blocks >= 1, F.sequence(F.lit(1), blocks)).otherwise(F.array().cast("array<int>"))
    unequal = F.filter(ks, lambda k: F.substring(a, (k - 1) * BLOCK + 1, F.lit(BLOCK)) != F.substring(b, (k - 1) * BLOCK + 1, F.lit(BLOCK)))
    return F.coalesce(F.get(unequal, F.lit(0)) - 1, blocks)


def _cut(a: Column, b: Column) -> Column:
    """The pair as struct, without its equal leading blocks."""
    skip = _equal_blocks(a, b) * BLOCK
    rest = F.lit(1 << 30)
    return _bound(skip, lambda k: F.struct(F.substring(a, k + 1, rest).alias("a"), F.substring(b, k + 1, rest).alias("b")))


def _chars(s: Column) -> Column:
    return F.when(F.char_length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, "", -1))


def within_edits(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two strings is at most ``edits``.

    Bit k of word e tells that the automaton can be on diagonal k - ``edits``
    after the characters read so far with e edits. Equal ends are cut off first.
    """
    head = _cut(a, b)
    both = _bound(head, lambda h: _cut(F.reverse(h["a"]), F.reverse(h["b"])))
    width = 2 * edits + 1
    full = (1 << width) - 1

    def shifted(x: Column, by: int) -> Column:
        return (F.shiftleft(x, by) if by > 0 else F.shiftright(x, -by)).bitwiseAND(F.lit(full))

    def closed(words: list[Column]) -> list[Column]:
        """A character of b alone moves one diagonal up and costs one edit."""
        out = [words[0]]
        for w in words[1:]:
            out.append(w.bitwiseOR(shifted(out[-1], 1)))
        return out

    def struct(words: list[Column]) -> Column:
        return F.struct(*(w.alias(f"w{e}") for e, w in enumerate(words)))

    def run(x: Column, y: Column) -> Column:
        # x and y are arrays of characters; diagonal k - edits pairs x[j] with y[j + k - edits].
        def step(acc: Column, j: Column) -> Column:
            c = F.get(x, j)
            equal = F.lit(0)
            for k in range(width):
                at = j + (k - edits)
                equal = equal.bitwiseOR(F.when((at >= 0) & F.coalesce(F.get(y, F.greatest(at, F.lit(0))) == c, F.lit(False)), 1 << k).otherwise(0))

            def words(m: Column) -> Column:
                out = []
                for e in range(edits + 1):
                    w = acc[f"w{e}"].bitwiseAND(m)
                    if e:
                        w = w.bitwiseOR(acc[f"w{e - 1}"]).bitwiseOR(shifted(acc[f"w{e - 1}"], -1))
                    out.append(w)
                return struct(closed(out))

            dead = F.lit(0)
            for e in range(edits + 1):
                dead = dead.bitwiseOR(acc[f"w{e}"])
            return F.when(dead == 0, acc).otherwise(_bound(equal, words))

        start = struct(closed([F.lit(1 << edits)] + [F.lit(0)] * edits))
        js = F.when(F.size(x) >= 1, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
        diagonal = F.size(y) - F.size(x) + edits
        last = F.aggregate(js, start, step)

        def any_of(s: Column) -> Column:
            out = s["w0"]
            for e in range(1, edits + 1):
                out = out.bitwiseOR(s[f"w{e}"])
            return out

        any_word = _bound(last, any_of)
        return F.when((diagonal < 0) | (diagonal >= width), False).otherwise(
            F.call_function("shiftright", any_word, F.greatest(diagonal, F.lit(0)).cast("int")).bitwiseAND(F.lit(1)) == 1
        )

    return _bound(both, lambda p: _bound(F.struct(_chars(p["a"]).alias("a"), _chars(p["b"]).alias("b")), lambda q: run(q["a"], q["b"])))


def signature(line: Column) -> Column:
    """Bit by bit whether an odd number of the line's letter pairs hash to it; an edit changes at most :data:`PAIRS_PER_EDIT` bits."""

    def parity(c: Column) -> Column:
        pairs = F.transform(c, lambda x, i: F.pmod(F.xxhash64(x, F.get(c, i + 1)), F.lit(64)).cast("int"))
        return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))

    # The last letter pairs with nothing, which is one more pair that an edit at the end changes along with the one before it.
    return _bound(_chars(line), parity)


def _near(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines of these signatures can be within the edits at all."""
    return F.bit_count(a.bitwiseXOR(b)) <= PAIRS_PER_EDIT * edits


def distinct_lines(found: DataFrame, edits: int) -> DataFrame:
    """``no, h1, h2`` and the keys of the distinct lines that may have an edit, written to the shared folder."""
    n = F.char_length("line")
    named = found.filter(n >= CHARS_PER_EDIT).select(F.encode("line", "UTF-32").alias("wide"), *digests(F.col("line")))
    named = named.withColumn("n", F.floor(F.octet_length("wide") / 4).cast("int"))
    keyed, own, near = segment_keys(named, edits)
    # Equal lines have equal keys and fold in the tasks first: a line of any number of copies sends one row per task, of numbers only.
    folded = keyed.groupBy("h1", "h2").agg(*(F.max(k).alias(k) for k in own + near))
    return materialise(folded.withColumn("no", F.monotonically_increasing_id()))


def _entries(lines: DataFrame, kind: str) -> DataFrame:
    columns = [F.col(c) for c in lines.columns if c.startswith(kind)]
    return lines.select("no", F.explode(F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull()))).alias("key"))


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(SLOTS))


def _from(wide: Column, at: Column) -> Column:
    """What follows ``at`` characters of a string in UTF-32."""
    return F.substring(wide, 4 * at + 1, F.lit(1 << 30))


def _upto(wide: Column, at: Column) -> Column:
    return F.substring(wide, F.lit(1), 4 * at)


def cut_again(rows: DataFrame, edits: int, only: DataFrame | None = None) -> DataFrame:
    """Entries of what is left of lines, by their segments: ``key, rest`` and ``index`` anew, the other columns as they were.

    ``rows``: ``no, sign``, ``rest`` (what is left, in UTF-32), ``shorter`` (characters that the lines it looks for have less),
    ``t`` (edits allowed), ``index`` (whether it is looked for, else it only looks) and ``key`` (null for whole lines, whose keys
    are those of :func:`segment_keys`). With ``only``, entries of its ``key`` alone.
    """
    n = F.floor(F.octet_length("rest") / 4).cast("int")
    sized = rows.withColumn("m", n - F.col("shorter")).filter((F.col("t") >= 1) & (F.col("shorter") <= F.col("t")))
    m, t, shorter = F.col("m"), F.col("t"), F.col("shorter")
    spots = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(by).alias("by")) for i in range(edits + 1) for by in range(-edits, edits + 1)))

    def possible(x: Column) -> Column:
        # Of t edits at most i lie before segment i + 1 and t - i after it.
        i, by = x["i"], x["by"]
        return (i <= t) & (by >= F.greatest(-i, shorter - (t - i))) & (by <= F.least(i, shorter + t - i))

    def entry(x: Column) -> Column:
        i, by = x["i"], x["by"]
        size, early = F.floor(m / (t + 1)).cast("int"), t + 1 - m % (t + 1)
        begin = size * i + F.greatest(i - early, F.lit(0)) + by
        length = size + F.when(i >= early, 1).otherwise(0)
        piece = F.substring("rest", 4 * begin + 1, 4 * length)
        key = F.when(F.col("key").isNull(), F.xxhash64(m, i, piece)).otherwise(F.xxhash64("key", m, i, piece))
        return F.struct(key.alias("key"), begin.alias("begin"), (begin + length).alias("end"), (F.col("index") & (by == 0)).alias("index"))

    others = [c for c in rows.columns if c not in ("key", "index", "rest")]
    each = sized.select(*others, F.col("rest").alias("whole"), F.explode(F.transform(F.filter(spots, possible), entry)).alias("x"))
    each = each.select(*others, "whole", "x.*")
    if only is not None:
        each = each.join(only, "key", "left_semi")
    rest = F.concat(_upto(F.col("whole"), F.col("begin")), F.lit(HOLE), _from(F.col("whole"), F.col("end")))
    return each.select(*others, "key", "index", rest.alias("rest"))


def deletion_links(entries: DataFrame) -> DataFrame:
    """``a, b`` (a > b): links between lines of one key whose rests are within ``t`` (1 or 2) edits; each line to one centre of each of its groups.

    Groups are named by what stays of a rest after deletions and by the places of
    these, so that each member of a group is within the edits of its centre:
    two places in common (two substitutions), one deletion each (a deletion and
    an insertion), one place in common (a substitution and a deletion; a member
    of the longer kind is no centre), deletions only (the shorter rest is the
    centre). Holes are never deleted.
    """
    rest = F.col("rest")
    size = F.floor(F.octet_length(rest) / 4).cast("int")
    places = F.filter(F.transform(F.sequence(F.lit(1), size), lambda k: k - 1), lambda k: F.substring(rest, 4 * k + 1, 4) != F.lit(HOLE))

    def without(x: Column, k: Column) -> Column:
        return F.concat(_upto(x, k), _from(x, k + 1))

    ones = F.transform(places, lambda k: F.struct(k.alias("g1"), without(rest, k).alias("v")))
    twos = F.flatten(
        F.transform(
            places,
            lambda j: F.transform(
                F.filter(places, lambda k: k > j), lambda k: F.struct(j.alias("g1"), (k - 1).alias("g2"), without(without(rest, k), j).alias("v"))
            ),
        )
    )

    def group(kind: str, v: Column, centre: bool, g1=-1, g2=-1) -> Column:
        place = [(F.lit(g) if isinstance(g, int) else g).alias(name) for g, name in ((g1, "g1"), (g2, "g2"))]
        return F.struct(F.lit(kind).alias("kind"), v.alias("v"), *place, F.lit(centre).alias("centre"))

    whole = F.array(group("deleted", rest, True))
    of_one = F.concat(whole, F.transform("ones", lambda x: group("deleted", x["v"], False)), F.transform("ones", lambda x: group("place", x["v"], True, x["g1"])))
    of_two = F.concat(
        whole,
        F.transform("twos", lambda x: group("deleted", x["v"], False)),
        F.transform("twos", lambda x: group("places", x["v"], True, x["g1"], x["g2"])),
        F.array(group("each", rest, True)),
        F.transform("ones", lambda x: group("each", x["v"], True)),
        F.transform("ones", lambda x: group("place", x["v"], True, x["g1"])),
        F.transform("twos", lambda x: group("place", x["v"], False, x["g1"])),
        F.transform("twos", lambda x: group("place", x["v"], False, x["g2"])),
    )
    cut = entries.select("no", "key", "t", "rest", ones.alias("ones"), twos.alias("twos"))
    named = cut.select("no", "key", F.explode(F.when(F.col("t") == 1, of_one).otherwise(of_two)).alias("x")).select("no", "key", "x.*")
    by = ["key", "kind", "v", "g1", "g2"]
    centres = named.groupBy(*by).agg(F.min(F.when(F.col("centre"), F.col("no"))).alias("of"), F.min("no").alias("l"), F.max("no").alias("m"))
    # Groups of one line go before rows are joined back.
    met = named.join(centres.filter("of IS NOT NULL AND l < m").select(*by, "of"), by).filter(F.col("no") != F.col("of"))
    return met.select(F.greatest("no", "of").alias("a"), F.least("no", "of").alias("b")).distinct()


def refined_pairs(lines: DataFrame, hot: DataFrame, edits: int) -> list[DataFrame]:
    """``a, b`` of lines under the keys of ``hot``, written tables; they connect all lines that are within the edits and share such a key.

    ``lines``: ``no, sign, line``. Each step cuts an equal segment out of the lines of a crowded
    key, so that about log(length) steps remain; rows a step grow with the lines, not with pairs of them.
    """
    rows = lines.select("no", "sign", F.encode("line", "UTF-32").alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("shorter"))
    length = F.floor(F.octet_length("rest") / 4).cast("int")
    rows = rows.select("*", allowed_edits(length - F.col("shorter"), edits).alias("t"), (F.col("shorter") == 0).alias("index"), F.lit(None).cast("bigint").alias("key"))
    entries, out = materialise(cut_again(rows, edits, only=hot)), []
    while True:
        crowded = materialise(entries.filter("index").groupBy("key").count().filter(F.col("count") > CROWD).select("key"))
        few = entries.join(crowded, "key", "left_anti").select("no", "key", "sign", "index")
        out.append(materialise(_meet(few.filter("index"), few.filter(~F.col("index")), lambda: _near(F.col("sign"), F.col("sign_b"), edits)).distinct()))
        more = None
        if not crowded.isEmpty():
            many = entries.join(crowded, "key", "left_semi")
            # For more edits than deletions are worked out for, rests are cut as long as they have a character for each segment.
            ended = F.when(F.col("t") <= STARRED, length <= SHORT).otherwise(length - F.col("shorter") <= 2 * F.col("t") + 2)
            out.append(materialise(deletion_links(many.filter(ended & (F.col("t") <= STARRED)))))
            if edits > STARRED:
                left = many.filter(ended & (F.col("t") > STARRED))
                out.append(materialise(_meet(left.filter("index"), left.filter(~F.col("index")), lambda: _near(F.col("sign"), F.col("sign_b"), edits)).distinct()))
            more = materialise(cut_again(many.filter(~ended), edits))
        release(entries)
        release(crowded)
        if more is None:
            return out
        entries = more


def texts_of(found: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``no, line`` for the ``no`` of ``wanted``, written to the shared folder."""
    wanted = materialise(wanted.distinct().join(lines.select(F.col("no").alias("of"), "h1", "h2"), F.col("no") == F.col("of")).select("no", "h1", "h2"))
    named = found.filter(F.char_length("line") >= CHARS_PER_EDIT).select("line", *digests(F.col("line")))
    some = possibly_in(named, F.col("h1"), wanted, F.col("h1"))
    texts = some.groupBy("h1", "h2").agg(F.first("line").alias("line"))
    out = materialise(texts.join(wanted.withColumnsRenamed({"h1": "g1", "h2": "g2"}), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select("no", "line"))
    release(wanted)
    return out


def _meet(index: DataFrame, probe: DataFrame, near) -> DataFrame:
    """``a, b`` (a > b) of index entries of one key, and of those with the probes; ``near()`` is a further condition."""

    def met(left: DataFrame, condition: Column) -> DataFrame:
        right = index.withColumnsRenamed({c: f"{c}_b" for c in index.columns})
        pairs = left.join(right, (F.col("key") == F.col("key_b")) & condition & near())
        return pairs.select(F.greatest("no", "no_b").alias("a"), F.least("no", "no_b").alias("b"))

    return met(index, F.col("no") > F.col("no_b")).unionByName(met(probe, F.col("no") != F.col("no_b")))


def candidate_pairs(found: DataFrame, lines: DataFrame, edits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``a, b`` (a > b) of lines that share a key, and ``no, line`` and ``no, sign`` of all these lines; written to the shared folder.

    All lines within the edits are connected by such pairs: pair by pair where few lines share a key, over
    :func:`refined_pairs` elsewhere. Texts are read in one pass, for either way.
    """
    index, probe = _entries(lines, "own"), _entries(lines, "near")
    counts = index.groupBy(_slot(F.col("key")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    crowded = materialise(counts.filter(F.col("n") > FEW).select("slot"))
    some = index if crowded.count() > SLOTS // 4 else index.join(F.broadcast(crowded), _slot(F.col("key")) == F.col("slot"), "left_semi")
    hot = materialise(some.groupBy("key").count().filter(F.col("count") > FEW).select("key"))

    def split(entries: DataFrame, how: str) -> DataFrame:
        return entries.join(hot, "key", how)

    plain = materialise(_meet(split(index, "left_anti"), split(probe, "left_anti"), lambda: F.lit(True)).distinct())
    refined = materialise(split(index.unionByName(probe), "left_semi").select("no").distinct())
    wanted = [refined.select("no"), plain.select(F.col("a").alias("no")), plain.select(F.col("b").alias("no"))]
    texts = texts_of(found, lines, reduce(DataFrame.unionByName, wanted))
    signs = materialise(texts.select("no", signature(F.col("line")).alias("sign")))
    again = texts.join(refined, "no", "left_semi").join(signs, "no")
    steps = refined_pairs(again, hot, edits)
    pairs = materialise(reduce(DataFrame.unionByName, [plain, *steps]).distinct())
    for done in (crowded, hot, plain, refined, *steps):
        release(done)
    return pairs, texts, signs


def line_links(found: DataFrame, lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """``a, b`` (a > b): numbers of distinct lines within the edits that the shorter one allows; all such lines are connected by links, and those without a crowded key linked one by one."""
    pairs, texts, signs = candidate_pairs(found, lines, edits)
    met = pairs
    for side in "ab":
        met = met.join(signs.withColumnsRenamed({c: f"{c}_{side}" for c in signs.columns}), F.col(side) == F.col(f"no_{side}"))
    both = met.filter(_near(F.col("sign_a"), F.col("sign_b"), edits)).select("a", "b")
    for side in "ab":
        both = both.join(texts.select(F.col("no").alias(f"of_{side}"), F.col("line").alias(f"line_{side}")), F.col(side) == F.col(f"of_{side}"))
    most = allowed_edits(F.least(F.char_length("line_a"), F.char_length("line_b")), edits)
    verdict = F.lit(False)
    for t in range(1, edits + 1):
        verdict = F.when(most == t, within_edits(F.col("line_a"), F.col("line_b"), t)).otherwise(verdict)
    links = materialise(both.filter(verdict).select("a", "b"))
    release(pairs)
    release(texts)
    release(signs)
    return links


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """``doc_id, row_no, line_no, class, kept`` of every line with a word, and one row of nulls for every row without one.

    ``class`` names the line's class: equal lines, and lines connected by links
    of at most one edit for each :data:`CHARS_PER_EDIT` characters of the
    shorter line, up to ``edits``. The first line of a class, by document id,
    row and place, is kept; null ids come last. ``row_no`` tells rows of equal
    ids, and repeated rows, apart. Two lines with the same 128 bits of digest
    but different checksums stop the run.
    """
    found = occurrences(docs, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row_no"), F.col("line_no"))
    worded = F.col("line").isNotNull()
    # A row without words gets numbers of its own, so that such rows don't meet under one key.
    names = [F.when(worded, d).otherwise(F.col("row_no")).alias(k) for k, d in zip(("h1", "h2"), digests(F.col("line")), strict=True)]
    marks = materialise(found.select("doc_id", "row_no", "line_no", *names, F.crc32(F.col("line").cast("binary")).alias("sum")))
    lines = distinct_lines(found, edits)
    roots = components(line_links(found, lines, edits))
    ids = lines.select("no", "h1", "h2")
    linked = roots.join(ids, F.col("node") == F.col("no")).select("root", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    linked = materialise(linked.join(ids.select("no", F.col("h1").alias("c1"), F.col("h2").alias("c2")), F.col("root") == F.col("no")).select("g1", "g2", "c1", "c2"))
    release(lines)
    clash = F.raise_error(F.lit("two lines share a digest")).cast("bigint")
    groups = marks.filter("sum IS NOT NULL").groupBy("h1", "h2").agg(F.min(place).alias("best"), F.min("sum").alias("s0"), F.max("sum").alias("s1"))
    groups = groups.select(F.when(F.col("s0") == F.col("s1"), F.col("h1")).otherwise(clash).alias("h1"), "h2", "best")
    named = groups.join(linked, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    named = materialise(named.select("h1", "h2", "best", F.col("c1").isNotNull().alias("linked"), F.coalesce("c1", "h1").alias("c1"), F.coalesce("c2", "h2").alias("c2")))
    release(linked)
    # Only linked lines have a class of several; their table is no larger than that of the links.
    least = named.filter("linked").groupBy(F.col("c1").alias("d1"), F.col("c2").alias("d2")).agg(F.min("best").alias("first"))
    classes = named.join(least, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")), "left")
    classes = materialise(classes.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "c1", "c2", F.coalesce("first", "best").alias("first")))
    release(named)
    kept = (F.col("row_no") == F.col("first.row_no")) & (F.col("line_no") == F.col("first.line_no"))
    placed = marks.join(classes, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    name = F.lower(F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0")))
    return placed.select("doc_id", "row_no", F.when(F.col("sum").isNotNull(), F.col("line_no")).alias("line_no"), name.alias("class"), kept.alias("kept"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """``doc_id, row_no, n_lines, dropped`` for every row: how many lines with a word it has and which go, by number from 0.

    Null and empty texts have no line. Rows of one id, and repeated rows, have a
    row each. An empty table gives no rows. Other columns don't matter.
    """
    classes = line_classes(docs, id_col, text_col, edits)
    gone = F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("line_no"))))
    return classes.groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), F.count("line_no").alias("n_lines"), gone.alias("dropped")).select("doc_id", "row_no", "n_lines", "dropped")


def drop_near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """``docs`` with the dropped lines cut out of ``text``; same columns, whatever their names. Rows of equal ids are told apart."""
    own, of, cut = (free_name(docs, x) for x in ("row", "of", "cut"))
    # Written once, so that a row's number is the same wherever it is read.
    numbered = materialise(docs.withColumn(own, F.monotonically_increasing_id()))
    as_ids = numbered.select(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(own).alias("own")).alias("id"), F.col(text_col).alias("text"))
    gone = dropped_lines(as_ids, "id", "text", edits).filter(F.size("dropped") > 0).select(F.col("doc_id.own").alias(of), F.col("dropped").alias(cut))
    joined = numbered.join(gone, F.col(own) == F.col(of), "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.col(cut), i))
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))
