"""A trie of conversation prefixes from vertical bitmaps.

Conversations are dealt to tasks by ranges of their id and cut into shards of a
bounded number. A shard indexes (position, turn) to the set of its
conversations as the bits of one integer. Depth first, a node's set is
intersected with the postings of the next position; what is left of it is a
child, and the bits without a next turn are the conversations that end there.
Every shard gives a row a node: the number of its conversations, the least id,
and the ids that end there as text, in order.

Nodes are named by a digest of their turns, so shards meet in one aggregation.
Ids of one end come in order of their shards and are hashed as a stream. Sums
over subtrees go by doubling: a node hands its sum to the ancestor 1, 2, 4, ...
levels above, in as many joins as the depth has binary digits. Only nodes of two
conversations or more take part; below them there are only single lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.storage import materialise, release

#: Conversations of a shard, and turns beyond which a shard takes no further conversation.
SHARD, SHARD_TURNS = 4096, 1 << 16
#: Bytes of a node's digest.
DIGEST = 16
ROOT = b"\0" * DIGEST
#: Rows that a task passes on at once.
ROWS = 1 << 14
NO_ENDS = hashlib.sha256().hexdigest()

NODE = "node binary, parent binary, depth bigint, chars bigint, n bigint, first bigint, ends string"


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, turn, chars`` with ``pos`` from 1: a digest of role and text, and the text's code points.

    By turn, null first; equal turns by their digest. Null roles and texts are
    empty. Rows without a conversation id belong to none and are left out.
    """
    role, text = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    found = rows.filter(rows[conv_col].isNotNull()).select(rows[conv_col].cast("bigint").alias("conv_id"), rows[turn_col].alias("at"), F.unhex(F.sha2(named, 256)).alias("turn"), F.char_length(text).cast("bigint").alias("chars"))
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "turn", "chars")
    return found.select("conv_id", F.row_number().over(place).cast("bigint").alias("pos"), "turn", "chars")


def whole(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn, chars`` of conversations as they are, with a row of nulls (``pos`` 0) for each of them."""
    return turns.unionByName(_marks(turns))


def _marks(turns: DataFrame) -> DataFrame:
    null = F.lit(None)
    return turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("bigint").alias("pos"), null.cast("binary").alias("turn"), null.cast("bigint").alias("chars"))


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """As :func:`whole`, for conversations that open with the first ``head`` turns of conversation ``base`` and go on with their own turns after so many.

    Both are expressions of ``conv_id``; ``head`` is ``most`` at most. What is
    read of a base is its ``most`` first turns, once for each conversation that builds on it.
    """
    heads = turns.filter(F.col("pos") <= most).select(F.col("conv_id").alias("of"), "pos", "turn", "chars")
    asked = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), head.cast("bigint").alias("head"))
    taken = asked.join(heads, (F.col("base") == F.col("of")) & (F.col("pos") <= F.col("head"))).select("conv_id", "pos", "turn", "chars")
    # A base with too few turns leaves a gap, which only places have and their order hasn't.
    return taken.unionByName(turns.filter(F.col("pos") > head)).unionByName(_marks(turns))


def child_of(node: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(node + turn, digest_size=DIGEST).digest()


def shard_nodes(convs: list[tuple[int, list[bytes], list[int]]]) -> Iterator[tuple]:
    """Rows of :data:`NODE` for a shard's conversations: id, turns' digests and sizes, by rising id."""
    postings: list[dict[bytes, int]] = []
    ended: list[int] = []
    for i, (_, turns, _) in enumerate(convs):
        while len(postings) < len(turns):
            postings.append({})
        for at, turn in enumerate(turns):
            postings[at][turn] = postings[at].get(turn, 0) | 1 << i
        while len(ended) <= len(turns):
            ended.append(0)
        ended[len(turns)] |= 1 << i

    def lowest(bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def ids(bits: int) -> Iterator[str]:
        while bits:
            yield str(convs[lowest(bits)][0])
            bits &= bits - 1

    todo = [(ROOT, None, 0, 0, (1 << len(convs)) - 1)]
    while todo:
        node, parent, depth, chars, members = todo.pop()
        over = members & ended[depth]
        yield node, parent, depth, chars, members.bit_count(), convs[lowest(members)][0], ",".join(ids(over)) if over else None
        rest = members & ~over
        while rest:
            i = lowest(rest)
            turn = convs[i][1][depth]
            child = rest & postings[depth][turn]
            rest &= ~child
            todo.append((child_of(node, turn), node, depth + 1, convs[i][2][depth], child))


class Line:
    """The nodes of one conversation whose turns come one by one, in constant memory."""

    def __init__(self, conv: int):
        self.conv, self.node, self.parent, self.depth, self.chars = conv, ROOT, None, 0, 0

    def step(self, turn: bytes, chars: int) -> tuple:
        """The node before this turn, which goes on."""
        out = (self.node, self.parent, self.depth, self.chars, 1, self.conv, None)
        self.parent, self.node = self.node, child_of(self.node, turn)
        self.depth, self.chars = self.depth + 1, chars
        return out

    def end(self) -> tuple:
        return self.node, self.parent, self.depth, self.chars, 1, self.conv, str(self.conv)


def shards(rows: DataFrame) -> DataFrame:
    """The nodes of every shard of conversations ``conv_id, pos, turn, chars`` (:data:`NODE`)."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in NODE.split(", ")])

    def nodes(batches) -> Iterator[tuple]:
        convs: list[tuple[int, list[bytes], list[int]]] = []
        held, line = 0, None
        for batch in batches:
            for conv, turn, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if line is not None and line.conv != conv:
                    yield line.end()
                    line = None
                if line is None and (not convs or convs[-1][0] != conv):
                    if len(convs) >= SHARD or held >= SHARD_TURNS:
                        yield from shard_nodes(convs)
                        convs, held = [], 0
                    convs.append((conv, [], []))
                if turn is None:
                    continue
                if line is not None:
                    yield line.step(turn, chars)
                    continue
                convs[-1][1].append(turn)
                convs[-1][2].append(chars)
                held += 1
                if len(convs[-1][1]) >= SHARD_TURNS:
                    # One conversation that would fill a shard alone goes on as a line.
                    line = Line(conv)
                    _, turns, sizes = convs.pop()
                    if convs:
                        yield from shard_nodes(convs)
                    yield from (line.step(t, n) for t, n in zip(turns, sizes, strict=True))
                    convs, held = [], 0
        if line is not None:
            yield line.end()
        if convs:
            yield from shard_nodes(convs)

    def run(batches):
        ready = nodes(batches)
        while some := list(islice(ready, ROWS)):
            yield out(some)

    ranged = rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "turn", "chars")
    return ranged.mapInArrow(run, NODE)


def end_digests(parts: DataFrame) -> DataFrame:
    """``node, ends_sha256`` from ``node, first, ends`` of shards: the hash of all ids that end at a node, as a stream over its shards."""

    def run(batches):
        node, state = None, None
        for batch in batches:
            names, sums = [], []
            for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == node:
                    state.update(b"," + ends.encode())
                    continue
                if node is not None:
                    names.append(node)
                    sums.append(state.hexdigest())
                node, state = key, hashlib.sha256(ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sums, pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    # Shards are ranges of ids, so that the least member of a node tells their order.
    return parts.repartition("node").sortWithinPartitions("node", "first").select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, depth: int) -> DataFrame:
    """``node`` and the sums of ``leaves`` and ``saved`` over its subtree, from ``node, parent, leaves, saved`` up to ``depth`` levels deep."""
    now = materialise(nodes.select("node", F.col("parent").alias("up"), "leaves", "saved"))
    reach = 1
    while reach <= depth:
        given = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("to")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = now.select(F.col("node").alias("at"), F.col("up").alias("next"))
        some = now.join(given, F.col("node") == F.col("to"), "left").select(
            "node", "up", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
        )
        after = materialise(some.join(above, F.col("up") == F.col("at"), "left").select("node", F.col("next").alias("up"), "leaves", "saved"))
        release(now)
        now, reach = after, 2 * reach
    return now.drop("up")


def trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for every node of the trie of :func:`whole` or :func:`rebuilt` conversations.

    Nodes are the distinct openings of conversations, the empty one included; a
    node goes by its least member's id. Without conversations there is no node.
    A sum beyond a long stops the run.
    """
    parts = materialise(shards(conversations))
    merged = parts.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.sum("n").alias("n"), F.min("first").alias("conv_id"))
    nodes = materialise(merged)
    ends = materialise(end_digests(parts.filter("ends IS NOT NULL").select("node", "first", "ends")))
    release(parts)
    born = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n") == 1).alias("single"))
    # A node of one conversation has one leaf below or is one, and saves nothing.
    shared = nodes.filter("n > 1").join(born, F.col("node") == F.col("of"), "left").select(
        "node", "parent", "depth", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("single", F.lit(1)).alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"),
    )
    shared = materialise(shared)
    depth = shared.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(shared, depth)
    about = shared.select(F.col("node").alias("s_node"), F.col("conv_id").alias("s_conv"), "n_children").join(
        sums.select(F.col("node").alias("t_node"), "leaves", "saved"), F.col("s_node") == F.col("t_node")
    )
    about = materialise(about.drop("t_node"))
    release(shared)
    release(sums)
    over = ends.withColumnRenamed("node", "e_node")
    found = nodes.join(over, F.col("node") == F.col("e_node"), "left").join(about.drop("s_conv"), F.col("node") == F.col("s_node"), "left")
    # The parent of a node has its conversations and more, so only shared parents are looked up; others have the node's own one.
    found = found.select("node", "parent", "depth", "n", "conv_id", "ends_sha256", "n_children", "leaves", "saved", "e_node")
    up = about.select(F.col("s_node").alias("p_node"), F.col("s_conv").alias("p_conv"))
    found = found.join(up, F.col("parent") == F.col("p_node"), "left")
    single = F.col("n") == 1
    return found.select(
        "conv_id",
        "depth",
        F.when(F.col("parent").isNotNull(), F.coalesce("p_conv", "conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        # A node of one conversation goes on unless it ends here.
        F.when(single, F.when(F.col("e_node").isNull(), 1).otherwise(0)).otherwise(F.col("n_children")).cast("bigint").alias("n_children"),
        F.when(single, 1).otherwise(F.col("leaves")).cast("bigint").alias("n_leaves"),
        F.when(single, 0).otherwise(F.col("saved")).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie (:func:`trie`) of conversations as they are.

    Order and nulls as in :func:`ordered_turns`; repeated rows are turns of
    their own, an empty table gives no rows, other columns don't matter.
    """
    return trie(whole(materialise(ordered_turns(rows, conv_col, turn_col, role_col, text_col))))
