"""Spreadsheets as sparse cells ``(keys..., row, col, value)``: merged ranges, alignment, merging, similarity, templates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import NUMBER, bound, is_fraction, is_numeric_string, strip, to_number
from docmill.storage import materialise, release


def fill_merged(cells: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell of a merged range (``min_row, min_col, max_row, max_col``) gets its top-left value."""
    inner = ranges.select(
        *keys, "min_row", "min_col", F.explode(F.sequence("min_row", "max_row")).alias("row"), F.col("max_col").alias("_max")
    ).select(*keys, "min_row", "min_col", "row", F.explode(F.sequence("min_col", "_max")).alias("col"))
    corners = cells.select(*keys, F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("value").alias("_filled"))
    filled = inner.join(corners, [*keys, "min_row", "min_col"], "left").select(*keys, "row", "col", "_filled", F.lit(True).alias("_in"))
    both = cells.join(filled, [*keys, "row", "col"], "full")
    return both.select(*keys, "row", "col", F.when(F.col("_in"), F.col("_filled")).otherwise(F.col("value")).alias("value")).filter("value IS NOT NULL")


def normalize_cell(value: Column) -> Column:
    """``kind`` and ``key`` for comparison: numeric texts are numbers, blank is null; a NaN equals nothing and is null too."""
    bare = strip(value)
    number = to_number(bare)
    return (
        F.when(bare == "", F.lit(None))
        .when(number.isNotNull(), F.struct(F.lit("num").alias("kind"), (number + F.lit(0.0)).cast("string").alias("key")))
        .when(bare.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.struct(F.lit("date").alias("kind"), bare.alias("key")))
        .when(F.lower(bare) == "nan", F.lit(None))
        .otherwise(F.struct(F.lit("str").alias("kind"), bare.alias("key")))
    )


def _offsets(base: DataFrame, collect: DataFrame, keys: list[str], center: DataFrame | None, reach: int) -> DataFrame:
    """``keys, dr, dc, n``: equal cells for each offset within ``reach`` of the centre; the band of rows is part of the join key."""
    step = 2 * reach + 1
    if center is not None:
        collect = collect.join(center, keys)
    else:
        collect = collect.withColumn("r0", F.lit(0)).withColumn("c0", F.lit(0))
    low = F.floor((F.col("row") + F.col("r0") - reach) / step)
    c = collect.select(*keys, "k", F.col("row").alias("cr"), F.col("col").alias("cc"), "r0", "c0", F.explode(F.array(low, low + 1)).alias("band"))
    b = base.select(*keys, "k", F.col("row").alias("br"), F.col("col").alias("bc"), F.floor(F.col("row") / step).alias("band"))
    met = c.join(b, [*keys, "k", "band"]).select(*keys, "r0", "c0", (F.col("br") - F.col("cr")).alias("dr"), (F.col("bc") - F.col("cc")).alias("dc"))
    near = met.filter((F.abs(F.col("dr") - F.col("r0")) <= reach) & (F.abs(F.col("dc") - F.col("c0")) <= reach))
    return near.groupBy(*keys, "dr", "dc").agg(F.count(F.lit(1)).alias("n"))


def align_tables(base: DataFrame, collect: DataFrame, keys: list[str], reach: int = 10, collect_cells: int = 500) -> DataFrame:
    """``keys, dr, dc, n``: the offset that puts most equal non-empty cells of the collected table on the base; the first in row and column order wins ties.

    As in the feature's definition only the first ``collect_cells`` cells of a
    table are compared. Where none fits within ``reach``, the most frequent
    difference to the first three places of each value is refined by two rows
    and columns. Tables without a common value have no row.
    """

    def filled(df: DataFrame) -> DataFrame:
        """Cells that have a value, which a cheap test tells; the value itself is worked out once, when the table is written."""
        bare = df.select(*keys, "row", "col", strip(F.col("value")).alias("_bare"))
        return bare.filter((F.col("_bare") != "") & (F.lower("_bare") != "nan"))

    def keyed(df: DataFrame) -> DataFrame:
        k = normalize_cell(F.col("_bare"))
        return materialise(df.select(*keys, "row", "col", k.alias("_k")).select(*keys, "row", "col", F.concat(F.col("_k.kind"), F.lit(" "), F.col("_k.key")).alias("k")))

    b = keyed(filled(base))
    order = Window.partitionBy(*keys).orderBy("row", "col")
    c = keyed(filled(collect).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= collect_cells))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "dr", "dc")

    def top(df: DataFrame) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")

    near = materialise(top(_offsets(b, c, keys, None, reach)))
    rest = materialise(c.join(near.select(*keys), keys, "left_anti"))
    places = b.join(rest.select(*keys).distinct(), keys, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "k").orderBy("row", "col"))).filter("_n <= 3")
    places = places.select(*keys, "k", F.col("row").alias("br"), F.col("col").alias("bc"))
    far = rest.join(places, [*keys, "k"]).groupBy(*keys, (F.col("br") - F.col("row")).alias("dr"), (F.col("bc") - F.col("col")).alias("dc")).agg(F.count(F.lit(1)).alias("n"))
    center = top(far).select(*keys, F.col("dr").alias("r0"), F.col("dc").alias("c0"))
    return near.unionByName(top(_offsets(b, rest, keys, center, 2)))


def merged_value(a: Column, b: Column) -> Column:
    """Two cell texts as one: numbers add up, equal texts stay, different ones are joined by a comma, blank gives way."""
    x, y = to_number(strip(a)), to_number(strip(b))
    total = x + y
    shown = F.when((total == F.floor(total)) & (F.abs(total) < 1e15), total.cast("bigint").cast("string")).otherwise(F.round(total, 10).cast("string"))
    blank_a, blank_b = F.coalesce(strip(a) == "", F.lit(True)), F.coalesce(strip(b) == "", F.lit(True))
    return (
        F.when(blank_a & blank_b, F.lit(None).cast("string"))
        .when(blank_a, b)
        .when(blank_b, a)
        .when(x.isNotNull() & y.isNotNull(), shown)
        .when(strip(a) == strip(b), a)
        .otherwise(F.concat(a, F.lit(","), b))
    )


def merge_by_cell(cells: DataFrame, keys: list[str], order: str = "file_no") -> DataFrame:
    """Aligned cells of several files as one; later files fold into earlier ones, in order."""
    bare = strip(F.col("value"))
    told = cells.select(*keys, "row", "col", F.struct(order, "value", bare.alias("bare"), to_number(bare).alias("n")).alias("_x"))
    piles = told.filter("_x.bare <> ''").groupBy(*keys, "row", "col").agg(F.array_sort(F.collect_list("_x")).alias("_v"))

    def step(a: Column, x: Column) -> Column:
        """As :func:`merged_value`, with each text's bare form and number worked out once."""

        def added(total: Column) -> Column:
            whole = (total == F.floor(total)) & (F.abs(total) < 1e15)
            n = F.when(whole, total).otherwise(F.round(total, 10))
            shown = F.when(whole, total.cast("bigint").cast("string")).otherwise(n.cast("string"))
            return bound(shown, lambda s: F.struct(s.alias("value"), s.alias("bare"), n.alias("n")))

        joined = F.concat(a["value"], F.lit(","), x["value"])
        both = F.struct(joined.alias("value"), strip(joined).alias("bare"), F.lit(None).cast("double").alias("n"))
        return F.when(a["n"].isNotNull() & x["n"].isNotNull(), bound(a["n"] + x["n"], added)).when(a["bare"] == x["bare"], a).otherwise(both)

    first = bound(F.get("_v", F.lit(0)), lambda x: F.struct(x["value"].alias("value"), x["bare"].alias("bare"), x["n"].alias("n")))
    folded = F.when(F.size("_v") == 1, F.get("_v", F.lit(0))["value"]).otherwise(F.aggregate(F.slice("_v", F.lit(2), F.size("_v")), first, step)["value"])
    return piles.select(*keys, "row", "col", folded.alias("value"))


def line_coverage(base: DataFrame, collect: DataFrame, keys: list[str], index: str) -> DataFrame:
    """``keys, relation`` of two lines cell by cell; ``keys`` name the pair of lines, ``index`` the place in them (``col`` for rows, ``row`` for columns)."""
    b = base.select(*keys, index, normalize_cell(F.col("value")).alias("_b")).filter("_b IS NOT NULL")
    c = collect.select(*keys, index, normalize_cell(F.col("value")).alias("_c")).filter("_c IS NOT NULL")
    both = b.join(c, [*keys, index], "full")
    seen = both.groupBy(*keys).agg(
        F.coalesce(F.max(F.col("_b").isNotNull() & F.col("_c").isNotNull() & (F.col("_b") != F.col("_c"))), F.lit(False)).alias("clash"),
        F.max(F.col("_b").isNotNull() & F.col("_c").isNull()).alias("base_only"),
        F.max(F.col("_b").isNull() & F.col("_c").isNotNull()).alias("collect_only"),
        F.max(F.col("_c").isNotNull()).alias("some"),
    )
    relation = (
        F.when(~F.col("some"), "skip_empty")
        .when(F.col("clash") | (F.col("base_only") & F.col("collect_only")), "conflict")
        .when(F.col("collect_only"), "collect_covers_base")
        .otherwise("base_covers_collect")
    )
    return seen.select(*keys, relation.alias("relation"))


def line_similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two arrays of texts; both empty counts as equal."""
    n = F.greatest(F.size(a), F.size(b))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(strip(x), F.lit("")) == F.coalesce(strip(y), F.lit("")))
    return F.when(n > 0, F.size(F.filter(same, lambda s: s)) / n).otherwise(0.0)


#: Base lines that hold a value, beyond which it is a frequent one.
RARE = 64


#: Places of a group's longest line up to which shapes may meet by their parts.
NARROW = 12


def _met_shapes(c: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _pc, base_line, similarity`` of shapes ``keys, _pc`` and ``keys, _pb, base_line`` that have a place in common, the best of each ``_pc`` among them.

    A group's shapes meet all with all, or by their parts: every choice of places is a key, and of a key's base shapes the
    first counts. Which makes fewer rows is told from the numbers of shapes and the longest line.
    """
    per_side = lambda df, shape, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{name}"), F.collect_set(F.size(shape)).alias(f"_l{name}"))
    groups = per_side(c, "_pc", "c").join(per_side(b, "_pb", "b"), keys)
    longest = F.greatest(F.array_max("_lc"), F.array_max("_lb"))
    parts = (F.col("_nc") * F.size("_lb") + F.col("_nb") * F.size("_lc")) * F.pow(F.lit(2.0), longest)
    groups = materialise(groups.withColumn("_by_parts", (longest <= NARROW) & (parts < F.col("_nc") * F.col("_nb"))))
    some = {r["_by_parts"] for r in groups.select("_by_parts").distinct().collect()}

    def by_pairs() -> DataFrame:
        own = groups.filter("NOT _by_parts").select(*keys)
        met = c.join(own, keys, "left_semi").join(b, keys)
        # Where one line is shorter, its places beyond the end are empty.
        alike = F.size(F.filter(F.zip_with("_pc", "_pb", lambda x, y: F.coalesce(x, F.lit("")) == F.coalesce(y, F.lit(""))), lambda same: same))
        scored = met.withColumn("similarity", F.when(alike > 0, alike / F.greatest(F.size("_pc"), F.size("_pb"))))
        return scored.filter("similarity > 0").select(*keys, "_pc", "base_line", "similarity")

    def parts_of(df: DataFrame, shape: str, others: str, rare: str) -> DataFrame:
        """A row for each choice of places that hold no rare value, for each length of the other side's lines; what isn't chosen is a star."""
        rows = df.join(groups.filter("_by_parts").select(*keys, F.col(others).alias("_o")), keys).withColumn("_other", F.explode("_o")).drop("_o")
        rows = rows.withColumn("_n", F.greatest(F.size(shape), F.col("_other"))).filter("_n > 0")
        rows = rows.withColumn("_all", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.get(shape, i), F.lit(""))))
        chosen = lambda mask, i: F.call_function("getbit", mask, i) == 1
        bits = F.aggregate(F.transform("_all", lambda v, i: F.when(v == rare, 0).otherwise(F.call_function("shiftleft", F.lit(1), i))), F.lit(0), lambda m, x: m + x)
        rows = rows.withColumn("_bits", bits).filter("_bits > 0")
        rows = rows.withColumn("_mask", F.explode(F.sequence(F.lit(1), F.col("_bits")))).filter(F.col("_mask").bitwiseAND(F.col("_bits")) == F.col("_mask"))
        return rows.withColumn("_part", F.transform("_all", lambda v, i: F.when(chosen(F.col("_mask"), i), v).otherwise("*")))

    def by_parts() -> DataFrame:
        # A part has the places of both sides' longer line, so its size and the two lengths tell which lines meet.
        first = parts_of(b, "_pb", "_lc", "b").groupBy(*keys, F.col("_other").alias("_size"), F.size("_pb").alias("_other"), "_part").agg(F.min("base_line").alias("base_line"))
        asked = parts_of(c, "_pc", "_lb", "c").select(*keys, "_pc", F.size("_pc").alias("_size"), "_other", "_part", (F.bit_count("_mask") / F.col("_n")).alias("similarity"))
        return asked.join(first, [*keys, "_size", "_other", "_part"]).select(*keys, "_pc", "base_line", "similarity")

    if True not in some:
        return by_pairs()
    return by_pairs().unionByName(by_parts()) if False in some else by_parts()


def most_similar_line(base: DataFrame, collect: DataFrame, keys: list[str]) -> DataFrame:
    """For each collected ``line`` (array ``cells``) the best ``base_line`` and its ``similarity``.

    All base lines count, and the first of equally similar ones wins; with
    similarity 0 that is base line 1. Equal lines fold into their first. Lines
    that share a rare value (of at most :data:`RARE` base lines) are compared in
    full, which makes a bounded number of pairs a line. What others have in
    common are empty places and frequent values, so of these only the shapes
    meet: a line's empty and frequent places, and of one shape the first base line.
    Where a group's lines have few places and its shapes are many, they meet by the parts they have in common.
    """
    blank = lambda x: F.coalesce(strip(x), F.lit("")) == ""
    bare = F.transform(F.col("cells"), lambda x: F.coalesce(strip(x), F.lit("")))
    b = materialise(base.groupBy(*keys, bare.alias("cells")).agg(F.min("line").alias("base_line")))
    told = materialise(collect.select(*keys, "line", bare.alias("cells")))
    c = materialise(told.groupBy(*keys, "cells").agg(F.min("line").alias("first")))

    def places(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, name, F.posexplode("cells").alias("place", "v")).filter("v <> ''")

    held = places(b, "base_line").groupBy(*keys, "place", "v").agg(F.count(F.lit(1)).alias("_n"))
    frequent = materialise(held.filter(F.col("_n") > RARE).select(*keys, "place", "v"))
    at = [*keys, "place", "v"]
    pairs = places(c, "first").join(frequent, at, "left_anti").join(places(b, "base_line"), at).select(*keys, "first", "base_line").distinct()
    of_c, of_b = c.select(*keys, "first", F.col("cells").alias("_c")), b.select(*keys, "base_line", F.col("cells").alias("_b"))
    scored = pairs.join(of_c, [*keys, "first"]).join(of_b, [*keys, "base_line"]).select(*keys, "first", "base_line", line_similarity(F.col("_c"), F.col("_b")).alias("similarity"))

    def shaped(df: DataFrame, name: str, other: str) -> DataFrame:
        """Empty places as such, frequent values with a sign in front, ``other`` for rare values, which nothing of the other side equals."""
        known = places(df, name).join(frequent, at).groupBy(*keys, name).agg(F.collect_set("place").alias("_f"))
        sign = F.transform("cells", lambda x, i: F.when(blank(x), "").when(F.coalesce(F.array_contains("_f", i), F.lit(False)), F.concat(F.lit("="), x)).otherwise(other))
        return df.join(known, [*keys, name], "left").select(*keys, name, sign.alias("shape"))

    c_shapes = materialise(shaped(c, "first", "c"))
    b_shapes = shaped(b, "base_line", "b").groupBy(*keys, F.col("shape").alias("_pb")).agg(F.min("base_line").alias("base_line"))
    best_of = lambda: F.max_by(F.struct("base_line", "similarity"), F.struct("similarity", -F.col("base_line")))
    met = _met_shapes(materialise(c_shapes.select(*keys, F.col("shape").alias("_pc")).distinct()), materialise(b_shapes), keys).groupBy(*keys, "_pc").agg(best_of().alias("_e"))
    by_shape = c_shapes.join(met.withColumnRenamed("_pc", "shape"), [*keys, "shape"]).select(*keys, "first", "_e.base_line", "_e.similarity")
    best = scored.unionByName(by_shape).groupBy(*keys, "first").agg(best_of().alias("_b"))
    named = c.join(best, [*keys, "first"], "left").select(*keys, "cells", "_b")
    out = told.join(named, [*keys, "cells"], "left")
    return out.select(*keys, "line", F.coalesce("_b.base_line", F.lit(1).cast("bigint")).alias("base_line"), F.coalesce("_b.similarity", F.lit(0.0)).alias("similarity"))


def row_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row, a, b``: runs of neighbouring non-blank cells of a row, from column ``a`` to ``b``.

    A run's cells have the same difference of column and rank in the row; a row's columns rank within bands of columns,
    so that a wide row isn't one task's work, and runs that meet at a band's edge are neighbours like those of two rows.
    """
    some = cells.filter(strip(F.col("value")) != "").select(*keys, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"))
    banded = some.distinct().withColumn("band", F.floor(F.col("col") / BAND))
    rank = F.row_number().over(Window.partitionBy(*keys, "row", "band").orderBy("col"))
    return banded.withColumn("_g", F.col("col") - rank).groupBy(*keys, "row", "band", "_g").agg(F.min("col").alias("a"), F.max("col").alias("b"))


def least_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of each component of ``edges`` (``a, b``) over ``nodes`` (``node``), by large-star and small-star steps.

    Each step is written to the shared folder. A node's least neighbour is an aggregate that is joined back, so that a
    node of many edges needn't have them in one task.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialise(oriented(edges))
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(oriented(large.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))))
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(oriented(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))))
        release(large)
        release(now)
        now, before = after, seen
        seen = state(now)
        if seen == before:
            break
    return nodes.join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"))


#: Columns of a band of a row.
BAND = 1 << 10


def find_blocks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, min_row, min_col, max_row, max_col``: boxes of 4-neighbour components of non-blank cells.

    A row's runs of cells are the nodes; two runs of rows below each other are linked where their columns overlap, which a
    band of columns in the key finds, and runs that meet at a band's edge are linked too. Components come from joins, so a
    sheet of any size is many tasks' work. Null keys name a sheet of their own.
    """
    runs = materialise(row_runs(cells, keys).withColumn("node", F.monotonically_increasing_id()))
    sheet = [F.xxhash64(F.struct(*keys)).alias("sheet"), F.struct(*keys).alias("key")]
    upper = runs.select(*sheet, "row", "band", F.col("node").alias("a_node"), F.col("a").alias("a0"), F.col("b").alias("a1"))
    lower = upper.withColumnsRenamed({"a_node": "b_node", "a0": "b0", "a1": "b1", "key": "key_b", "sheet": "sheet_b", "row": "row_b", "band": "band_b"})
    same = (F.col("sheet") == F.col("sheet_b")) & F.col("key").eqNullSafe(F.col("key_b"))
    below = upper.join(lower, same & (F.col("row") + 1 == F.col("row_b")) & (F.col("band") == F.col("band_b")) & (F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")))
    beside = upper.join(lower, same & (F.col("row") == F.col("row_b")) & (F.col("band") + 1 == F.col("band_b")) & (F.col("a1") + 1 == F.col("b0")))
    edges = below.unionByName(beside).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    roots = materialise(least_labels(runs.select("node"), edges).select(F.col("node").alias("of"), "root"))
    boxed = runs.join(roots, F.col("node") == F.col("of")).groupBy(*keys, "root").agg(F.min("row").alias("min_row"), F.min("a").alias("min_col"), F.max("row").alias("max_row"), F.max("b").alias("max_col"))
    return boxed.select(*keys, "min_row", "min_col", "max_row", "max_col")


def blocks_to_markdown(cells: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, min_row, min_col, markdown``: each box as pipe table, its first row as header; line feeds become ``<br>``, pipes are escaped."""
    grid = blocks.withColumn("row", F.explode(F.sequence("min_row", "max_row"))).withColumn("col", F.explode(F.sequence("min_col", "max_col")))
    shown = F.replace(F.regexp_replace(strip(F.coalesce("value", F.lit(""))), r"\r?\n", "<br>"), F.lit("|"), F.lit("\\|"))
    at = [*keys, "min_row", "min_col", "row"]
    rows = grid.join(cells.select(*keys, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "value"), [*keys, "row", "col"], "left")
    rows = rows.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("col", shown.alias("v")))).alias("_c"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("_c", lambda c: c["v"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size("_c")))
    rows = rows.select(*at, F.concat(line, F.when(F.col("row") == F.col("min_row"), rule).otherwise("")).alias("_l"))
    tables = rows.groupBy(*at[:-1]).agg(F.sort_array(F.collect_list(F.struct("row", "_l"))).alias("_r"))
    return tables.select(*at[:-1], F.array_join(F.transform("_r", lambda r: r["_l"]), "\n").alias("markdown"))


def _number(x: str) -> float | None:
    try:
        return None if "_" in x else float(x)
    except ValueError:
        return None


def _grid_merge(base: list[list[str]], collect: list[list[str]]) -> list[list[str]]:
    """Collected lines into base lines, one after another; each step sees what earlier ones did.

    Values stand as small numbers, blanks (and NaN, which equals nothing) as zero, so that a line meets all lines of the grid at once.
    """
    width = max(map(len, base + collect), default=0)
    known: dict[object, int] = {}
    texts: dict[str, int] = {"": 0}

    def coded(lines: list[list[str]]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        full = [line + [""] * (width - len(line)) for line in lines]
        equal, alike = np.zeros((len(lines), width), "int64"), np.zeros((len(lines), width), "int64")
        for i, line in enumerate(full):
            for j, x in enumerate(line):
                bare = x.strip()
                number = _number(bare)
                alike[i, j] = texts.setdefault(bare, len(texts))
                if bare and not (number is not None and number != number):
                    equal[i, j] = known.setdefault(bare if number is None else number, len(known) + 1)
        return full, equal, alike

    grid, equal, alike = coded(base)
    told, told_equal, told_alike = coded(collect)
    n, room = len(grid), len(grid) + len(told)
    equal, alike = np.resize(equal, (room, width)), np.resize(alike, (room, width))
    for line, new, shown in zip(told, told_equal, told_alike, strict=True):
        if not shown.any():
            continue
        own, here = equal[:n], new != 0
        filled = own != 0
        clash = (filled & here & (own != new)).any(axis=1)
        less, more = (filled & ~here).any(axis=1), (~filled & here).any(axis=1)
        fits = np.flatnonzero(~clash & filled.any(axis=1) & ~(less & more))
        if len(fits):
            at = int(fits[0])
            if not more[at]:
                continue
            grid[at] = line
        else:
            at = int((alike[:n] == shown).sum(axis=1).argmax()) + 1 if n else 0
            grid.insert(at, line)
            equal[at + 1 : n + 1], alike[at + 1 : n + 1] = equal[at:n].copy(), alike[at:n].copy()
            n += 1
        equal[at], alike[at] = new, shown
    return grid


#: Rows that a task of :func:`_by_group` gathers before it passes them on.
OUT_ROWS = 20_000


def _by_group(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[list[tuple]], list[tuple]], made: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``keys`` and the columns ``made`` (name: SQL and Arrow type) of ``work(rows of a group, in order)``, for many groups in one Python call.

    One exchange by key; a group is in memory as a whole, others aren't. Null keys are a group.
    """
    told = [c for c in rows.columns if c not in keys]
    near = rows.repartition(*keys).withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).sortWithinPartitions("_key", *order)

    def run(batches):
        heads, sizes, out = [], [], []

        def passed():
            table = pa.Table.from_batches(heads).take(np.repeat(np.arange(len(heads)), sizes))
            for i, (name, (_, kind)) in enumerate(made.items()):
                table = table.append_column(name, pa.array([r[i] for r in out], kind))
            yield from table.combine_chunks().to_batches()

        def closed():
            if held:
                found = work(held)
                heads.append(head)
                sizes.append(len(found))
                out.extend(found)

        now, head, held = None, None, []
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in told]
            for i, key in enumerate(batch.column("_key").to_pylist()):
                if key != now:
                    closed()
                    if len(out) >= OUT_ROWS:
                        yield from passed()
                        heads, sizes, out = [], [], []
                    now, head, held = key, batch.select(keys).slice(i, 1), []
                held.append(tuple(v[i] for v in values))
        closed()
        if out:
            yield from passed()

    return near.mapInArrow(run, ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} {t}" for n, (t, _) in made.items())]))


def merge_by_row(base: DataFrame, collect: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, line, cells``: base lines with the collected lines merged in, in their order; a covering line replaces, a covered one is dropped, others go below the most similar line.

    Every step depends on the one before, so a merge group is one task's work:
    groups should stay small, :func:`merge_by_cell` has no such bound.
    """
    rows = base.select(*keys, F.lit(0).alias("_side"), "line", "cells").unionByName(collect.select(*keys, F.lit(1).alias("_side"), "line", "cells"))

    def merged(lines: list[tuple]) -> list[tuple]:
        sides = [[["" if v is None else str(v) for v in cells or ()] for side, _, cells in lines if side == s] for s in (0, 1)]
        return list(enumerate(_grid_merge(*sides), 1))

    return _by_group(rows, keys, ["_side", "line"], merged, {"line": ("bigint", pa.int64()), "cells": ("array<string>", pa.list_(pa.string()))})


def merge_by_column(base: DataFrame, collect: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row, col, value`` of the non-blank cells: as :func:`merge_by_row` for columns of cells ``(keys, row, col, value)``, rows and columns from 1.

    A collected column goes to the right of the most similar one, which moves later columns. Where a place has two values, the largest counts.
    """
    cell = [F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("string").alias("value")]
    rows = base.select(*keys, F.lit(0).alias("_side"), *cell).unionByName(collect.select(*keys, F.lit(1).alias("_side"), *cell))

    def merged(cells: list[tuple]) -> list[tuple]:
        sides: tuple[dict, dict] = ({}, {})
        for side, row, col, value in cells:
            sides[side][col, row] = value or ""
        size = [(max((c for c, _ in s), default=0), max((r for _, r in s), default=0)) for s in sides]
        grid = _grid_merge(*([[s.get((c, r), "") for r in range(1, rows + 1)] for c in range(1, columns + 1)] for s, (columns, rows) in zip(sides, size, strict=True)))
        return [(r, c, v) for c, line in enumerate(grid, 1) for r, v in enumerate(line, 1) if v.strip()]

    return _by_group(rows, keys, ["_side", "row", "col", "value"], merged, {"row": ("int", pa.int32()), "col": ("int", pa.int32()), "value": ("string", pa.string())})


PLACEHOLDER = r"\{\{\s*([↓→]?)\s*([^{}]+?)\s*\}\}"


def template_placeholders(template: DataFrame, text_col: str = "text") -> DataFrame:
    """Every placeholder of a cell: ``mode`` (scalar, column, row), ``key``, ``n`` within the cell and whether it fills the ``whole`` cell."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(PLACEHOLDER), F.lit(0))
    rows = template.select("*", F.posexplode(found).alias("n", "_raw"))
    sign = F.regexp_extract("_raw", PLACEHOLDER, 1)
    mode = F.when(sign == "↓", "column").when(sign == "→", "row").otherwise("scalar")
    return rows.select(*template.columns, "n", mode.alias("mode"), F.regexp_extract("_raw", PLACEHOLDER, 2).alias("key"), (strip(F.col(text_col)) == F.col("_raw")).alias("whole"))


def filled_text(text: Column, record: Column, keys: list[str], separator: str = "、") -> Column:
    """A template text with the record's (map of arrays) values for ``keys``; placeholders left over become empty."""
    for k in keys:
        value = F.coalesce(F.array_join(F.filter(record[k], lambda v: v.isNotNull()), separator), F.lit(""))
        text = F.replace(text, F.lit("{{" + k + "}}"), value)
    return F.regexp_replace(text, r"\{\{[^{}]*\}\}", "")


def fill_cells(template: DataFrame, records: DataFrame, keys: list[str], text_col: str = "text", record_col: str = "record") -> DataFrame:
    """Mail merge: every template cell for every record, with ``value`` and ``vtype`` (formula for fractions, text for long digit strings, number, text).

    The template is a few rows of configuration and is broadcast; ``keys`` are its scalar keys.
    """
    rows = records.crossJoin(F.broadcast(template))
    value = filled_text(F.col(text_col), F.col(record_col), keys)
    whole = strip(F.col(text_col)).rlike(rf"\A{PLACEHOLDER}\z")
    rows = rows.withColumn("value", value)
    v = F.col("value")
    kind = (
        F.when(whole & is_fraction(v), "formula")
        .when(whole & strip(v).rlike(r"\A\d{16,}\z"), "text")
        .when(whole & is_numeric_string(v), "number")
        .otherwise("text")
    )
    rows = rows.withColumn("vtype", kind)
    return rows.withColumn("value", F.when(F.col("vtype") == "formula", F.concat(F.lit("="), strip(v))).otherwise(v)).drop(record_col)


def fill_down(slots: DataFrame, values: DataFrame, merged: DataFrame, keys: list[str], protected: DataFrame | None = None) -> DataFrame:
    """``↓`` placeholders: value i of a column key goes to the i-th writable cell from the placeholder down.

    ``slots(template keys, key, row, col)`` are placeholders, ``values(keys, key, value_no, value)`` number from 1;
    cells of ``merged(min_row, min_col, max_row, max_col)`` ranges other than the first are skipped without taking a value.
    With ``protected(row, col)`` a column ``written`` follows: protected cells take a value, which is not written and calls for a warning.
    """
    return _fill(slots, values, merged, keys, protected, ("row", "col"))


def fill_right(slots: DataFrame, values: DataFrame, merged: DataFrame, keys: list[str], protected: DataFrame | None = None) -> DataFrame:
    """``→`` placeholders: as ``fill_down``, to the right."""
    return _fill(slots, values, merged, keys, protected, ("col", "row"))


def _fill(slots: DataFrame, values: DataFrame, merged: DataFrame, keys: list[str], protected: DataFrame | None, axes: tuple[str, str]) -> DataFrame:
    along, across = axes
    most = values.groupBy(*keys, "key").agg(F.max("value_no").alias("_most"))
    spare = merged.agg(F.coalesce(F.sum((F.col("max_row") - F.col("min_row") + 1) * (F.col("max_col") - F.col("min_col") + 1)), F.lit(0)).alias("_spare"))
    rows = most.join(F.broadcast(slots), "key").crossJoin(F.broadcast(spare))
    rows = rows.select(*keys, "key", across, F.explode(F.sequence(F.col(along).cast("bigint"), F.col(along) + F.col("_most") + F.col("_spare") - 1)).alias(along), F.col(along).alias("_from"))
    blocked = merged.select("min_row", "max_row", "min_col", "max_col")
    skip = (F.col("row").between(F.col("min_row"), F.col("max_row"))) & (F.col("col").between(F.col("min_col"), F.col("max_col"))) & ~((F.col("row") == F.col("min_row")) & (F.col("col") == F.col("min_col")))
    free = rows.join(F.broadcast(blocked), skip, "left_anti")
    numbered = free.withColumn("value_no", F.row_number().over(Window.partitionBy(*keys, "key", across, "_from").orderBy(along)).cast("bigint"))
    filled = numbered.join(values.withColumn("value_no", F.col("value_no").cast("bigint")), [*keys, "key", "value_no"]).select(*keys, "key", "row", "col", "value_no", "value")
    if protected is None:
        return filled
    # A template's own cells, as its slots and ranges are.
    closed = protected.select("row", "col").distinct().withColumn("_closed", F.lit(True))
    return filled.join(F.broadcast(closed), ["row", "col"], "left").select(*filled.columns, F.col("_closed").isNull().alias("written"))


def fill_paragraphs(template: DataFrame, records: DataFrame, keys: list[str], groups: list[list[str]], text_col: str = "text", record_col: str = "record") -> DataFrame:
    """Paragraph templates for every record; a paragraph goes when all keys of a group that it names are empty. Unknown keys become empty."""
    rows = records.crossJoin(F.broadcast(template))

    def empty(k: str) -> Column:
        return F.coalesce(F.forall(F.col(record_col)[k], lambda v: F.coalesce(strip(v) == "", F.lit(True))), F.lit(True))

    def named(k: str) -> Column:
        return F.contains(F.col(text_col), F.lit("{{" + k + "}}"))

    gone = F.lit(False)
    for g in groups:
        hit = F.lit(True)
        for k in g:
            hit = hit & named(k) & empty(k)
        gone = gone | hit
    rows = rows.filter(~gone)
    return rows.withColumn(text_col, filled_text(F.col(text_col), F.col(record_col), keys)).drop(record_col)
