"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at distance d or less share a variant that lies within d/2 of
both. Every distinct fingerprint therefore emits all variants within half the
radius, and fingerprints that meet on a variant are linked. Those that meet are
at most the radius apart from each other, so each is linked to the smallest of
its variant only (a star), never to all others; every link of the radius has its
variant, so connected components lose nothing. Components come from alternating
large-star and small-star steps.

For similarity of shingle sets, where 64 bits would need a ball of a radius
near 14, the same is done on several shorter words of a set's fingerprint
(:func:`set_words`, :func:`word_links`); who meets there is to be verified.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.storage import materialise, release

BITS = 64
#: Shingle hashes that are turned into bits at once.
BLOCK = 1 << 16
#: Short words of a set's fingerprint, bits that a word has beyond log2 of the number of sets, and the most bits.
WORDS, SPARE_BITS, MOST_WORD_BITS = 6, 9, 40
#: Bits below a word's variant: the place of the flipped bit.
PLACE_BITS = 6

_LANES = np.random.default_rng(4).integers(0, 1 << 64, (2, WORDS), np.uint64)


def fingerprint(text: str, width: int = 3) -> int:
    """Bit by bit the majority of the hashes of all shingles of a whole text, as a signed 64-bit integer."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :][:n].tolist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(first, last, strict=True)], repeat(42)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        counts += np.unpackbits(h[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row; texts without words, empty or null, have fingerprint 0."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def masks(radius: int) -> list[int]:
    """All bit patterns of at most ``radius`` bits, as signed 64-bit integers."""
    out = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def ball_links(points: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b`` with a > b: verified links that connect all fingerprints ``fp`` (distinct) within an even ``radius``."""
    if radius % 2:
        raise ValueError("the radius must be even: variants cover half of it on either side")
    # The masks are a column of an expression, so no Python touches a row.
    variants = points.select("fp", F.explode(F.array(*(F.lit(m) for m in masks(radius // 2)))).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    # No variant has more points than masks, so its window is bounded.
    least = F.min("fp").over(Window.partitionBy("variant"))
    met = variants.withColumn("b", least).filter(F.col("fp") > F.col("b")).select(F.col("fp").alias("a"), "b").distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def word_bits(sets: int) -> int:
    """Bits of a short word that let few of so many sets meet by chance."""
    return min(MOST_WORD_BITS, max(16, sets.bit_length() + SPARE_BITS))


def set_words(h: np.ndarray, bits: int) -> np.ndarray:
    """The short words of a set of shingle hashes: bit by bit the majority of the shingles, the word's number above its ``bits``."""
    counts = np.zeros(BITS * WORDS, np.int64)
    for k in range(0, len(h), BLOCK):
        x = (h[k : k + BLOCK, None] ^ _LANES[0]) * (_LANES[1] | np.uint64(1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.unpackbits((x ^ (x >> np.uint64(29))).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    words = np.packbits(2 * counts > len(h), bitorder="little").view("<i8") & ((1 << bits) - 1)
    return words | (np.arange(WORDS) << bits)


def word_links(points: DataFrame, bits: int) -> DataFrame:
    """``a, b``: short words ``fp`` (distinct, as :func:`set_words` gives them) within two bits, each linked to one word of its variant.

    A row carries its variant and the flipped bit's place in one number, from which the word follows.
    """
    flips = [k | (1 << (k - 1 + PLACE_BITS) if k else 0) for k in range(bits + 1)]
    spread = points.select("fp", F.explode(F.array(*(F.lit(x).cast("bigint") for x in flips))).alias("flip")).select(F.shiftleft("fp", PLACE_BITS).bitwiseXOR(F.col("flip")).alias("packed"))
    met = spread.repartition(F.shiftright("packed", PLACE_BITS)).select("packed", F.shiftright("packed", PLACE_BITS).alias("variant"))

    def word(packed: Column) -> Column:
        place = packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        flipped = F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), place - 1)).otherwise(F.lit(0).cast("bigint"))
        return F.shiftright(packed, PLACE_BITS).bitwiseXOR(flipped)

    # No variant has more words than a word has bits and one, so its window is bounded.
    least = F.min("packed").over(Window.partitionBy("variant"))
    return met.withColumn("least", least).filter("packed > least").select(word(F.col("packed")).alias("a"), word(F.col("least")).alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node reachable, for every node that has a link.

    Alternates large-star and small-star until no link changes. A node's least
    neighbour is an aggregate that is joined back, so a hub's links needn't
    meet in one task. Every step is written to the shared folder.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def summary(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialise(oriented(links.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    seen = summary(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Every node also keeps its own least neighbour, so no node is lost.
        large = materialise(oriented(large.unionByName(now.join(least, F.col("a") == F.col("u")).select("a", F.col("m").alias("b")))))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(oriented(small.unionByName(low.select("a", F.col("m").alias("b")))))
        release(large)
        state = summary(after)
        if state == seen:
            release(now)
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        release(now)
        now, seen = after, state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits, the row's own included; rows of equal fingerprint
    are linked. Null text counts as empty; texts without words share
    fingerprint 0. Null ids are never the smallest, and a component of null ids
    only has a null ``component_id``. Repeated rows fall into one component. An
    empty table gives no rows. Other columns of ``docs`` don't matter.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, width))
    points = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(ball_links(points.select("fp"), radius))
    labelled = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labelled = materialise(labelled)
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least.select(F.col("root").alias("r"), "component_id"), F.col("root") == F.col("r")).select(F.col("fp").alias("key"), "component_id")
    # A written table has no partitioning of its own, so Spark exchanges both sides and can split a hot fingerprint.
    named = materialise(named)
    return marked.join(named, marked["fp"] == named["key"]).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with the smallest id of every component only; same columns.

    Rows with a null id stay if no other id is in their component.
    """
    # Only ids that go are joined; an id that repeats shares its fate when all its rows do.
    found = near_duplicates(docs, id_col, text_col, width, radius)
    goes = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_goes")).distinct()
    return docs.join(materialise(goes), docs[id_col].eqNullSafe(F.col("_goes")), "left_anti")
