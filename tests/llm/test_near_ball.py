"""The near-dedup stage goes through SimHash ball hashing; the prefix filter finds what the ball misses."""

import random

import numpy as np

import corpus_pipeline
from docmill.llm import near_dedup, simhash


def connected(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def near_texts():
    """20 groups of a text of 300 words and three copies with a changed word, similar by 0.96 or more."""
    rnd, out = random.Random(4), []
    for g in range(20):
        base = [f"g{g}w{rnd.randrange(10_000)}" for _ in range(300)]
        out.append(" ".join(base))
        for k in range(3):
            c = list(base)
            c[rnd.randrange(300)] = f"other{k}"
            out.append(" ".join(c))
    return out


def test_pipeline_stage_joins_near_copies_by_the_ball(spark, make_docs, tmp_path, monkeypatch):
    make_docs(list(enumerate(near_texts()))).write.parquet(f"{tmp_path}/d")
    # Without the prefix filter only the ball's links are left.
    monkeypatch.setattr(near_dedup, "similar_links", lambda *_, known, **__: known[0])
    kept = corpus_pipeline.near(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()
    assert {r.doc_id for r in kept} >= set(range(0, 80, 4)) and len(kept) <= 22


def test_prefix_filter_finds_what_the_ball_misses(spark, make_docs, tmp_path, monkeypatch):
    make_docs(list(enumerate(near_texts()))).write.parquet(f"{tmp_path}/d")
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_dedup, "ball_links", lambda *_, **__: (none, none))
    kept = corpus_pipeline.near(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()
    assert {r.doc_id for r in kept} == set(range(0, 80, 4))


def test_word_links_connect_all_words_within_two_bits(spark):
    rnd, bits = random.Random(5), 20
    points = set()
    for _ in range(60):
        x = rnd.randrange(1 << bits)
        for _ in range(rnd.randrange(1, 9)):
            points.add(rnd.randrange(3) << bits | x)
            for _ in range(rnd.randrange(1, 4)):
                x ^= 1 << rnd.randrange(bits)
    close = {(a, b) for a in points for b in points if a > b and a >> bits == b >> bits and (a ^ b).bit_count() <= 2}
    got = [(max(r), min(r)) for r in map(tuple, simhash.word_links(spark.createDataFrame([(x,) for x in points], "fp long"), bits).collect())]
    assert set(got) <= close and connected(points, got) == connected(points, close)


def test_words_of_a_set():
    h = np.random.default_rng(1).integers(0, 1 << 64, 500, np.uint64)
    words = simhash.set_words(h, 24)
    assert [int(w) >> 24 for w in words] == list(range(simhash.WORDS))
    assert (simhash.set_words(h[::-1], 24) == words).all()
    # Of sets with nothing in common about half of the bits differ.
    other = simhash.set_words(h ^ np.uint64(0x5DEECE66D), 24)
    assert 0.3 < sum((int(a) ^ int(b)).bit_count() for a, b in zip(words, other, strict=True)) / (24 * simhash.WORDS) < 0.7


def test_counters_travel_by_byte():
    counts = np.array([0, 1, 255, 256, 70_000, (1 << 32) - 1] + [3] * 1018, np.uint32)
    assert (near_dedup._from_planes(near_dedup._planes(counts)) == counts).all()
