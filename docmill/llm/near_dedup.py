"""Near-dedup by SimHash ball hashing, verified by the Jaccard similarity of five-word shingles.

First the ball hashing of :mod:`docmill.llm.simhash` on short words of each set's
fingerprint: sets whose words meet on a variant are verified, and components are
formed of the links. Most near copies are together then.

The ball misses pairs, the more the less similar they are. So that none is lost,
sets of different components go through an exact prefix filter: with all shingles
in one order, rarest first, two texts of similarity s or more share a shingle among the first
n - ceil(s n) + 1 of each. At the first shingle they share, the shingles left on
either side must still suffice, which tells most texts of a common passage
apart. Any order finds all pairs; a count sketch of fixed size over all
documents only makes it a good one. Whatever meets is verified on the whole
shingle sets.

Texts of one shingle set fold into one node first. Under each shingle every node
is compared with one hub, the node with the most common shingles. Components of
these links are formed, and then every pair of a shingle that still lies in two
components is compared, so components are those of all similar pairs, while a
large group of near copies doesn't meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.simhash import components, set_words, word_bits, word_links
from docmill.llm.text import free_name, possibly_in
from docmill.storage import materialise, release

#: Words of a shingle, and the least similarity of near copies as numerator and denominator.
WIDTH, SIMILAR = 5, (4, 5)
#: Counters of the sketch as a power of two, and those that travel together.
COUNTER_BITS, COUNTER_BLOCK = 20, 1 << 10
#: Words of 64 bits in a node's parity map.
MAP_WORDS = 8
#: Digests of nodes that a task remembers so as to pass a node on once; the memory is emptied when full.
REMEMBERED = 100_000
#: Bits below a node's score: partition and row of the table where nodes are numbered.
NUMBER_BITS = 51


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of all shingles of a whole text; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :][:n].tolist()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(first, last, strict=True)], repeat(42)), np.uint64, n))


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _planes(counts: np.ndarray) -> bytes:
    """A block of counters with all low bytes first: the others are mostly zero, and a run of them compresses well."""
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(block: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def marked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, text, node, n`` for every row: the digest and size of its shingle set.

    Each task adds rows of ``block, counts`` for its part of the sketch, with nulls elsewhere.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    names = ["doc_id", "text", "node", "n", "block", "counts"]

    def run(batches):
        counts, kind = np.zeros(1 << COUNTER_BITS, np.uint32), None
        for batch in batches:
            nodes, sizes = [], []
            for t in batch.column(1):
                h = shingles(t.as_py(), width)
                nodes.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                np.add.at(counts, _counter(h), 1)
            kind, m = batch.schema.field(0).type, batch.num_rows
            columns = [*batch.columns, pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if kind is not None:
            blocks = counts.reshape(-1, COUNTER_BLOCK)
            used = np.flatnonzero(blocks.any(axis=1))
            m = len(used)
            columns = [pa.nulls(m, kind), pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(used, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([_planes(blocks[k]) for k in used], pa.binary())], names=names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, node binary, n bigint, block int, counts binary")


def sketch(parts: DataFrame) -> np.ndarray:
    """The tasks' counters summed up: a table of fixed size, 8 bytes a counter."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(block, np.zeros(COUNTER_BLOCK, np.int64))
                held[block] += _from_planes(counts.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in held.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros((1 << COUNTER_BITS) // COUNTER_BLOCK * COUNTER_BLOCK, np.int64).reshape(-1, COUNTER_BLOCK)
    for row in parts.repartition("block").mapInArrow(run, "block int, counts binary").collect():
        out[row["block"]] += np.frombuffer(row["counts"], "<i8")
    return out.reshape(-1)


def prefix(h: np.ndarray, counts: np.ndarray, similar: tuple[int, int] = SIMILAR) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, one of which a similar set must have, in order; and how common they are, up to 2015."""
    c = counts[_counter(h)]
    order = np.lexsort((h, c))
    n = len(h)
    first = order[: n - -(-similar[0] * n // similar[1]) + 1]
    return h[first], int(32 * np.log2(np.maximum(c[first], 1)).mean())


def parity_map(h: np.ndarray) -> np.ndarray:
    """Bit by bit whether an odd number of shingles hash to it; two sets differ by as many shingles as bits at least."""
    odd = np.bincount((h % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def nodes_of(marked: DataFrame, counts: np.ndarray, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, bits: int = 0) -> DataFrame:
    """``no, node, n, keys, map``: one row for each distinct non-empty shingle set, written to the shared folder.

    ``no`` is unique and higher for sets of more common shingles. With ``bits`` also ``words``, the fingerprint's short words of so many bits.
    """
    shared = marked.sparkSession.sparkContext.broadcast(counts)
    names = ["node", "n", "score", "keys", "map", *(["words"] if bits else [])]

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows: list[tuple] = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                h = shingles(text.as_py(), width)
                keys, score = prefix(h, shared.value, similar)
                rows.append((node, len(h), score, keys.view(np.int64), parity_map(h), *([set_words(h, bits)] if bits else [])))
            kinds = (pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * (len(names) - 3))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    found = marked.filter("n > 0").select("node", "text").mapInArrow(run, "node binary, n bigint, score bigint, " + ", ".join(f"{c} array<bigint>" for c in names[3:]))
    folded = found.groupBy("node").agg(*(F.first(c).alias(c) for c in names[1:]))
    row = F.monotonically_increasing_id()
    fits = F.when(row < F.lit(1 << NUMBER_BITS), row).otherwise(F.raise_error(F.lit("too many partitions to number nodes")).cast("bigint"))
    return materialise(folded.select((F.call_function("shiftleft", F.col("score"), F.lit(NUMBER_BITS)) + fits).alias("no"), "node", "n", *names[3:]))


def _enough(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, similar: tuple[int, int]) -> Column:
    """Whether sets whose first common shingle has these places can be similar at all."""
    s, t = similar
    both = s * (n_a + n_b)
    sizes = t * F.least(n_a, n_b) >= s * F.greatest(n_a, n_b)
    return sizes & ((s + t) * (n_a - pos_a) >= both) & ((s + t) * (n_b - pos_b) >= both)


def sets_of_marked(marked: DataFrame, width: int = WIDTH) -> Callable[[DataFrame], DataFrame]:
    """How :func:`verified` gets the shingle sets of nodes from rows of ``node, text``."""

    def fetch(wanted: DataFrame) -> DataFrame:
        texts = possibly_in(marked.select("node", "text"), F.xxhash64("node"), wanted, F.xxhash64("key")).groupBy("node").agg(F.first("text").alias("text"))

        def run(batches):
            for batch in batches:
                sets = pa.array([shingles(t.as_py(), width).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["no", "h"])

        return texts.join(wanted, F.col("node") == F.col("key")).select("no", "text").mapInArrow(run, "no bigint, h array<bigint>")

    return fetch


def verified(pairs: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Those of the ``a, b`` whose whole shingle sets reach the similarity; written to the shared folder.

    ``nodes`` has ``no, node, n, map``; ``sets_of`` turns ``no, key`` (the node's digest) into ``no, h``.
    """
    small = nodes.select("no", "n", *(F.get("map", F.lit(k)).alias(f"m{k}") for k in range(MAP_WORDS)))
    sided = pairs.distinct()
    for side in "ab":
        sided = sided.join(small.withColumnsRenamed({c: f"{c}_{side}" for c in small.columns}), F.col(side) == F.col(f"no_{side}"))
    bits = sum((F.bit_count(F.col(f"m{k}_a").bitwiseXOR(F.col(f"m{k}_b"))) for k in range(MAP_WORDS)), F.lit(0))
    s, t = similar
    # Similar sets differ by (t - s) / (t + s) of both sizes at most.
    sizes = t * F.least("n_a", "n_b") >= s * F.greatest("n_a", "n_b")
    some = materialise(sided.filter(sizes & ((s + t) * bits <= (t - s) * (F.col("n_a") + F.col("n_b")))).select("a", "b"))
    wanted = some.select(F.col("a").alias("of")).unionByName(some.select(F.col("b").alias("of"))).distinct()
    wanted = materialise(wanted.join(nodes.select("no", "node"), F.col("of") == F.col("no")).select("no", F.col("node").alias("key")))
    sets = materialise(sets_of(wanted))
    release(wanted)
    both = some
    for side in "ab":
        both = both.join(sets.select(F.col("no").alias(f"no_{side}"), F.col("h").alias(f"h_{side}")), F.col(side) == F.col(f"no_{side}"))
    common = F.size(F.array_intersect("h_a", "h_b"))
    links = materialise(both.filter(t * common >= s * (F.size("h_a") + F.size("h_b") - common)).select("a", "b"))
    release(some)
    release(sets)
    return links


def ball_links(marked: DataFrame, nodes: DataFrame, bits: int, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """``a, b`` with a > b twice: verified links of nodes with a short word in common or within two bits, and all pairs compared; both written to the shared folder.

    ``nodes`` have ``words`` of so many ``bits``. Nodes of one word meet its hub, words meet one word of their variant.
    """
    s, t = similar
    placed = nodes.select("no", "n", F.explode("words").alias("word"))
    hubs = materialise(placed.groupBy("word").agg(F.max("no").alias("hub"), F.max_by("n", "no").alias("hub_n"), F.count(F.lit(1)).alias("size")).withColumnRenamed("word", "fp"))
    held = placed.join(hubs.filter("size > 1"), F.col("word") == F.col("fp")).filter("no < hub")
    pairs = held.select(F.col("hub").alias("a"), F.col("no").alias("b"), F.col("hub_n").alias("n_a"), F.col("n").alias("n_b"))
    met = word_links(hubs.select("fp"), bits)
    for side in "ab":
        met = met.join(hubs.select(F.col("fp").alias(f"fp_{side}"), F.col("hub").alias(f"hub_{side}"), F.col("hub_n").alias(f"n_{side}")), F.col(side) == F.col(f"fp_{side}"))
    pairs = pairs.unionByName(met.select(F.greatest("hub_a", "hub_b").alias("a"), F.least("hub_a", "hub_b").alias("b"), "n_a", "n_b").filter("a <> b"))
    compared = materialise(pairs.filter(t * F.least("n_a", "n_b") >= s * F.greatest("n_a", "n_b")).select("a", "b").distinct())
    release(hubs)
    return verified(compared, nodes, sets_of_marked(marked, width), similar), compared


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the ``a, b`` that lie in different components of ``of, root``."""
    for side in "ab":
        pairs = pairs.join(roots.select(F.col("of").alias(f"of_{side}"), F.col("root").alias(f"root_{side}")), F.col(side) == F.col(f"of_{side}"), "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def similar_links(marked: DataFrame, nodes: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``a, b``: verified links whose components are those of all similar pairs.

    ``known`` are links found before, which are among the result, and the pairs compared for them, which needn't meet again.
    """
    sets_of = sets_of_marked(marked, width)
    placed = nodes.select("no", "n", F.posexplode("keys").alias("pos", "key"))
    # Most shingles are in one set only, so they are counted by themselves first.
    shared = materialise(placed.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("k"))
    held = materialise(possibly_in(placed, F.col("key"), shared, F.col("k")).join(shared, F.col("key") == F.col("k")).select("key", "no", "n", "pos"))
    release(shared)
    hubs = held.groupBy(F.col("key").alias("k")).agg(F.max("no").alias("hub"), F.max_by("n", "no").alias("hub_n"), F.max_by("pos", "no").alias("hub_pos"))
    members = materialise(held.join(hubs, F.col("key") == F.col("k")).select("key", "no", "n", "pos", "hub", "hub_n", "hub_pos"))
    release(held)
    stars = members.filter((F.col("no") < F.col("hub")) & _enough(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"), similar))
    stars = stars.select(F.col("hub").alias("a"), F.col("no").alias("b"))
    if known is None:
        links = verified(stars, nodes, sets_of, similar)
    else:
        before = materialise(components(known[0]).select(F.col("node").alias("of"), "root"))
        links = known[0].unionByName(verified(_apart(stars.distinct(), before).join(known[1], ["a", "b"], "left_anti"), nodes, sets_of, similar))
        release(before)
    roots = materialise(components(links).select(F.col("node").alias("of"), "root"))
    rooted = members.join(roots, F.col("no") == F.col("of"), "left").select("key", "no", "n", "pos", "hub", F.coalesce("root", "no").alias("root"))
    rooted = materialise(rooted)
    release(members)
    release(roots)
    s, t = similar
    # Of a similar pair, the smaller set has its first common shingle this early.
    early = (s + t) * (F.col("n") - F.col("pos")) >= 2 * s * F.col("n")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.when(early, F.col("n"))).alias("least"))
    mixed = materialise(mixed.filter("lo <> hi AND least IS NOT NULL").select(F.col("key").alias("k"), "least"))
    # Who can't be similar even to the smallest set of a shingle's early ones has no partner there.
    left = rooted.join(mixed, F.col("key") == F.col("k")).filter((s + t) * (F.col("n") - F.col("pos")) >= s * (F.col("n") + F.col("least"))).select("key", "no", "n", "pos", "hub", "root")
    left = materialise(left)
    release(rooted)
    release(mixed)
    one = left.filter(early).select(*(F.col(c).alias(f"{c}_1") for c in ("key", "no", "n", "pos", "root")))
    larger = (F.col("n") > F.col("n_1")) | ((F.col("n") == F.col("n_1")) & (F.col("no") > F.col("no_1")))
    # The hub's own pairs have been compared.
    other = (F.col("root") != F.col("root_1")) & (F.col("no") != F.col("hub")) & (F.col("no_1") != F.col("hub"))
    met = left.join(one, (F.col("key") == F.col("key_1")) & larger & other & _enough(F.col("n"), F.col("pos"), F.col("n_1"), F.col("pos_1"), similar))
    met = met.select(F.greatest("no", "no_1").alias("a"), F.least("no", "no_1").alias("b"))
    if known is not None:
        met = met.distinct().join(known[1], ["a", "b"], "left_anti")
    rest = verified(met, nodes, sets_of, similar)
    release(left)
    return links.unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over verified links, the row's
    own included; rows of equal shingle sets are linked, texts without words
    too. Null text counts as empty. Null ids are never the smallest, and a
    component of null ids only has a null ``component_id``. An empty table gives
    no rows.
    """
    # The texts lie in the shared folder throughout, so they are packed more tightly.
    written = materialise(marked_rows(docs, id_col, text_col, width), "zstd")
    marked = written.filter("block IS NULL")
    bits = word_bits(marked.count())
    nodes = nodes_of(marked, sketch(written.filter("block IS NOT NULL").select("block", "counts")), width, bits=bits)
    links = similar_links(marked, nodes, width, known=ball_links(marked, nodes, bits, width))
    roots = components(links)
    # Only linked nodes have a root of their own to look up.
    linked = roots.join(nodes.select("no", F.col("node").alias("of")), F.col("node") == F.col("no")).select("of", "root")
    first = marked.groupBy("node").agg(F.min("doc_id").alias("first"))
    labelled = materialise(first.join(linked, F.col("node") == F.col("of"), "left").select(F.col("node").alias("key"), "first", "root"))
    least = labelled.filter("root IS NOT NULL").groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    named = materialise(labelled.join(least, F.col("root") == F.col("r"), "left").select("key", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")))
    release(labelled)
    release(nodes)
    found = materialise(marked.select("doc_id", "node").join(named, F.col("node") == F.col("key")).select("doc_id", "component_id"))
    release(named)
    release(written)
    return found


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of every component, that of the smallest id; same columns.

    Null ids come last, and of rows of one id the first place stays. ``docs`` is
    as read from files, where a row's place is the same in every scan.
    """
    own, of = free_name(docs, "own"), free_name(docs, "of")
    numbered = docs.withColumn(own, F.monotonically_increasing_id())
    as_ids = numbered.select(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(own).alias("own")).alias("id"), F.col(text_col).alias("text"))
    found = near_duplicates(as_ids, "id", "text", width)
    goes = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id.own").alias(of)))
    return numbered.join(goes, F.col(own) == F.col(of), "left_anti").select(*docs.columns)
