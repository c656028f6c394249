"""MinHash near-dedup by tensored banding.

Instead of a hash collection for each table there are two small collections of
bands (a few minhashes each); the key of table (i, j) is the pair of band i of
the first and band j of the second. So HALVES * HALVES tables cost 2 * HALVES
bands. A pair of similarity s misses all tables with a probability below
2 * (1 - s^ROWS)^HALVES: 2e-5 at 0.85, less above.

A table's key can only be shared where both bands are, so bands are counted
first and keys are formed from shared bands only. Texts of one shingle set fold
into one node before. In a bucket all nodes are verified against its least one
(a star), which joins large groups of near copies. Where a bucket's nodes are
still in several components, a small one is compared pair by pair, and the nodes
of larger ones go through the exact prefix filter of
:mod:`docmill.llm.near_dedup` among themselves, so that no bucket is capped.
All links are verified on whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm import near_dedup
from docmill.llm.near_dedup import REMEMBERED, parity_map, shingles
from docmill.llm.simhash import components
from docmill.llm.text import possibly_in
from docmill.storage import materialise, release

#: Words of a shingle, and the least similarity as numerator and denominator.
WIDTH, SIMILAR = 5, (85, 100)
#: Bands of either collection, and minhashes of a band.
HALVES, ROWS = 12, 3
#: Shingles that are minhashed at once.
BLOCK = 1 << 13
#: Nodes of a bucket that are compared pair by pair.
SMALL_BUCKET = 32

_SEEDS = np.random.default_rng(12).integers(0, 1 << 64, (3, 2 * HALVES * ROWS), np.uint64)
_MASK, _FACTOR, _MIX = _SEEDS[0], _SEEDS[1] | np.uint64(1), (_SEEDS[2] | np.uint64(1)).reshape(2 * HALVES, ROWS)


def bands(h: np.ndarray) -> np.ndarray:
    """The bands of both collections, one after the other, of a non-empty shingle set."""
    least = np.full(len(_MASK), ~np.uint64(0))
    for k in range(0, len(h), BLOCK):
        least = np.minimum(least, ((h[k : k + BLOCK, None] ^ _MASK) * _FACTOR).min(axis=0))
    return (least.reshape(2 * HALVES, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, node, n, bands, map`` for every row: digest and size of its shingle set, and what comparisons need.

    ``node`` is null for texts without words. Bands and map are null where the task has lately given them for an equal set.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                h = shingles(text.as_py(), width)
                node = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                if node is None or node in seen:
                    out.append((node, len(h), None, None))
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                out.append((node, len(h), bands(h), parity_map(h)))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=["doc_id", "node", "n", "bands", "map"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node binary, n bigint, bands array<bigint>, map array<bigint>")


def nodes_of(sketched: DataFrame) -> DataFrame:
    """``no, node, n, first, bands, map``: a row for each distinct non-empty set, with the least id that has it; written to the shared folder."""
    worded = sketched.filter("node IS NOT NULL")
    folded = worded.groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("first"), F.first("bands", True).alias("bands"), F.first("map", True).alias("map"))
    return materialise(folded.select(F.monotonically_increasing_id().alias("no"), "node", "n", "first", "bands", "map"))


def table_keys(nodes: DataFrame) -> DataFrame:
    """``no, key``: the tables' keys of every node, as far as both bands are shared."""
    placed = nodes.select("no", F.posexplode("bands").alias("place", "value")).select("no", "place", F.xxhash64("place", "value").alias("band"))
    shared = materialise(placed.groupBy(F.col("band").alias("k")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("k"))
    held = possibly_in(placed, F.col("band"), shared, F.col("k")).join(shared, F.col("band") == F.col("k"))
    sides = held.groupBy("no").agg(F.collect_list(F.when(F.col("place") < HALVES, F.col("band"))).alias("left"), F.collect_list(F.when(F.col("place") >= HALVES, F.col("band"))).alias("right"))
    pairs = F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.xxhash64(a, b))))
    keys = materialise(sides.select("no", F.explode(pairs).alias("key")))
    release(shared)
    return keys


def buckets(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b`` of each bucket's least node with its others, and ``key, no`` of the buckets of three or more; both written to the shared folder."""
    names = [F.bit_xor(F.xxhash64(F.lit(k), "no")).alias(f"name{k}") for k in range(2)]
    shared = keys.groupBy("key").agg(F.min("no").alias("hub"), F.max("no").alias("other"), F.count(F.lit(1)).alias("size"), *names).filter("size > 1")
    # Similar sets meet in many tables: of buckets with the same nodes, told by 128 bits, one is enough.
    shared = materialise(shared.groupBy("hub", "other", "size", "name0", "name1").agg(F.min("key").alias("k")).select("k", "hub", "other", "size"))
    large = shared.filter("size > 2")
    members = possibly_in(keys, F.col("key"), large, F.col("k")).join(large.select("k", "hub"), F.col("key") == F.col("k")).select("key", "no", "hub")
    members = materialise(members)
    pairs = shared.filter("size = 2").select(F.col("other").alias("a"), F.col("hub").alias("b"))
    stars = materialise(pairs.unionByName(members.filter("no > hub").select(F.col("no").alias("a"), F.col("hub").alias("b"))).distinct())
    release(shared)
    return stars, members


def sets_of_documents(docs: DataFrame, nodes: DataFrame, width: int = WIDTH):
    """How the wanted nodes' sets are read again from ``doc_id, text``: by the least id of a node, told apart by the digest where ids repeat."""

    def fetch(wanted: DataFrame) -> DataFrame:
        firsts = materialise(wanted.join(nodes.select("node", F.col("first").alias("id")), F.col("key") == F.col("node")).select("id").distinct())
        some = possibly_in(docs, F.xxhash64("doc_id"), firsts, F.xxhash64("id"))
        texts = some.join(firsts, F.col("doc_id").eqNullSafe(F.col("id"))).select("text")

        def run(batches):
            for batch in batches:
                sets = [shingles(t.as_py(), width) for t in batch.column(0)]
                names = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["node", "h"])

        found = texts.mapInArrow(run, "node binary, h array<bigint>").join(wanted, F.col("node") == F.col("key")).select("no", "h")
        # Rows of one id may repeat a text.
        return found.groupBy("no").agg(F.first("h").alias("h"))

    return fetch


def _rest(docs: DataFrame, nodes: DataFrame, large: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """``a, b``: links among the nodes ``no`` of ``large`` by the exact prefix filter."""
    asked = materialise(large.join(nodes.select(F.col("no").alias("of"), "node", F.col("first").alias("id")), F.col("no") == F.col("of")).select("no", "node", "id"))
    ids = asked.select("id").distinct()
    texts = possibly_in(docs, F.xxhash64("doc_id"), ids, F.xxhash64("id")).join(ids, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text")
    written = materialise(near_dedup.marked_rows(texts, "doc_id", "text", width))
    marked = written.filter("block IS NULL")
    own = near_dedup.nodes_of(marked, near_dedup.sketch(written.filter("block IS NOT NULL").select("block", "counts")), width, similar)
    links = near_dedup.similar_links(marked, own, width, similar)
    named = own.select(F.col("no").alias("theirs"), F.col("node").alias("called")).join(asked.select("no", "node"), F.col("called") == F.col("node")).select("theirs", "no")
    for side in "ab":
        links = links.join(named.select(F.col("theirs").alias(f"t_{side}"), F.col("no").alias(f"no_{side}")), F.col(side) == F.col(f"t_{side}"))
    out = materialise(links.select(F.col("no_a").alias("a"), F.col("no_b").alias("b")))
    for used in (asked, written, own):
        release(used)
    return out


def similar_links(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``a, b``: verified links of nodes, whose components are those of all similar pairs that meet in a table."""
    sets_of = sets_of_documents(docs, nodes, width)
    keys = table_keys(nodes)
    stars, members = buckets(keys)
    release(keys)
    links = near_dedup.verified(stars, nodes, sets_of, similar)
    roots = materialise(components(links).select(F.col("node").alias("of"), "root"))
    rooted = materialise(members.join(roots, F.col("no") == F.col("of"), "left").select("key", "no", "hub", F.coalesce("root", "no").alias("root")))
    release(members)
    release(roots)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    mixed = materialise(mixed.select(F.col("key").alias("k"), "size"))
    left = materialise(rooted.join(mixed, F.col("key") == F.col("k")).select("key", "no", "hub", "root", "size"))
    release(rooted)
    release(mixed)
    few = left.filter(F.col("size") <= SMALL_BUCKET)
    other = few.select(*(F.col(c).alias(f"{c}_1") for c in ("key", "no", "hub", "root")))
    # The hub's own pairs have been compared.
    unequal = (F.col("no") > F.col("no_1")) & (F.col("root") != F.col("root_1")) & (F.col("no_1") != F.col("hub_1"))
    met = few.join(other, (F.col("key") == F.col("key_1")) & unequal).select(F.col("no").alias("a"), F.col("no_1").alias("b"))
    more = near_dedup.verified(met, nodes, sets_of, similar)
    large = materialise(left.filter(F.col("size") > SMALL_BUCKET).select("no").distinct())
    links = links.unionByName(more)
    if large.head(1):
        links = links.unionByName(_rest(docs, nodes, large, width, similar))
    release(left)
    release(large)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Shingles are the distinct runs of ``width`` words, A-Z lower-cased, or all
    words of a shorter text; sets are compared by 64-bit hashes of their
    members. Texts whose sets reach the similarity are linked, equal sets too;
    texts without words, null ones included, have no shingle and no link.
    ``component_id`` is the smallest id reachable, the row's own included; null
    ids are never the smallest, and a component of null ids only has a null one.
    Rows whose id is the component's are kept, repeated ones too. An empty table
    gives no rows. Other columns of ``docs`` don't matter.
    """
    read = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sketched = materialise(sketches(docs, id_col, text_col, width))
    nodes = nodes_of(sketched)
    roots = components(similar_links(read, nodes, width, similar))
    labelled = materialise(nodes.select("no", "node", "first").join(roots.withColumnRenamed("node", "of"), F.col("no") == F.col("of"), "left").select("node", "first", "root"))
    least = labelled.filter("root IS NOT NULL").groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    named = labelled.join(least, F.col("root") == F.col("r"), "left").select(F.col("node").alias("key"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("named"))
    named = materialise(named)
    release(labelled)
    release(nodes)
    # Texts without words would all meet under the null key, so they don't take part.
    joined = sketched.filter("node IS NOT NULL").select("doc_id", "n", "node").join(named, F.col("node") == F.col("key")).select("doc_id", "n", "named")
    alone = sketched.filter("node IS NULL").select("doc_id", "n", F.col("doc_id").alias("named"))
    kept: Column = F.col("doc_id").eqNullSafe(F.col("named"))
    return joined.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("named").alias("component_id"), kept.alias("kept"))
