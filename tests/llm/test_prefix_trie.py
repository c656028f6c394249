"""Conversation tries against plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from docmill.llm import prefix_trie, queries


def brute(convs):
    """Rows of the trie of conv_id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        saved, leaves = (len(members[node]) - 1) * len(node[-1][1]) if node else 0, not children[node]
        for c in children[node]:
            s, n = below(c)
            saved, leaves = saved + s, leaves + n
        return saved, int(leaves)

    out = []
    for node, ids in members.items():
        saved, leaves = below(node)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rows):
    """Turns by conversation in order, of (conv_id, turn, role, text)."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    return {c: [(r[3], r[4]) for r in sorted(x)] for c, x in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, node long, depth string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = [(c, t, "user" if t % 2 == 0 else "assistant", rnd.choice(["hi", "hello é𝒳", f"own {c}", ""])) for c in list(range(230)) + [-5, 10**12] for t in range(rnd.randrange(1, 9))]
    out += [(500 + k, t, "user", f"same {t}") for k in range(40) for t in range(12)]
    out += [(600, None, None, None), (600, 0, None, "x"), (600, 0, "user", "x"), (600, 0, "user", "x"), (None, 1, "user", "lost")]
    return out


def test_trie_equals_plain(spark, rows):
    assert got(prefix_trie.conversation_trie(frame(spark, rows))) == brute(conversations(rows))


def test_query_rebuilds_conversations(spark, rows, tmp_path):
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    own = conversations(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert got(queries.op13_prefix_trie(spark, str(tmp_path))) == brute(rebuilt)


def test_small_shards_and_long_conversations(spark, rows, monkeypatch):
    many = rows + [(c, t, "user", f"long {min(t, 40)}" if c < 702 else f"{t}") for c in (700, 701, 702) for t in range(60)]
    convs = conversations(many)
    digests = [(c, [hashlib.sha256(repr(t).encode()).digest() for t in convs[c]], [len(t[1]) for t in convs[c]]) for c in sorted(convs)]
    whole = defaultdict(lambda: [0, []])
    for node, _, _, _, n, _, ends in prefix_trie.shard_nodes(digests):
        whole[node][0] += n
        whole[node][1] += [ends] if ends else []
    cut = defaultdict(lambda: [0, []])
    for k in range(0, len(digests), 7):
        for node, _, _, _, n, _, ends in prefix_trie.shard_nodes(digests[k : k + 7]):
            cut[node][0] += n
            cut[node][1] += [ends] if ends else []
    assert {k: (n, ",".join(e)) for k, (n, e) in whole.items()} == {k: (n, ",".join(e)) for k, (n, e) in cut.items()}
    line, nodes = prefix_trie.Line(7), []
    for t, n in zip(digests[-1][1], digests[-1][2], strict=True):
        nodes.append(line.step(t, n))
    nodes.append(line.end())
    assert nodes == sorted(prefix_trie.shard_nodes([(7, digests[-1][1], digests[-1][2])]), key=lambda r: r[2])


def test_a_conversation_longer_than_a_shard(spark):
    rows = [(c, t, "user", f"t{t}") for c in (1, 2, 3) for t in range(prefix_trie.SHARD_TURNS + 3 if c == 2 else 3)]
    out = prefix_trie.conversation_trie(frame(spark, rows))
    top = out.filter("depth = 0").first()
    assert (top.conv_id, top.n_convs, top.n_children, top.n_leaves, top.saved_tokens) == (1, 3, 1, 1, 3 * 2 * 2)
    assert out.count() == prefix_trie.SHARD_TURNS + 4
    last = out.filter(f"depth = {prefix_trie.SHARD_TURNS + 3}").first()
    assert last.ends_sha256 == hashlib.sha256(b"2").hexdigest() and last.parent_conv_id == 2


def test_empty(spark):
    assert prefix_trie.conversation_trie(frame(spark, [])).count() == 0
