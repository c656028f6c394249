"""MinHash near-dedup against all pairs."""

import random
import re

import pytest
from docmill.llm import minhash, near_dedup


def sets(rows):
    out = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    return out


def brute(rows, similar=(85, 100)):
    """doc_id, n_shingles, component_id, kept of each row, by all pairs."""
    s, at = sets(rows), list(range(len(rows)))

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and similar[1] * len(s[a] & s[b]) >= similar[0] * len(s[a] | s[b]):
                at[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, len(s[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def got(docs, **more):
    return sorted((tuple(r) for r in minhash.near_duplicates(docs, **more).collect()), key=str)


def noisy(rnd, words, share):
    return [f"n{rnd.randrange(10**6)}" if rnd.random() < share else w for w in words]


@pytest.fixture(scope="module")
def mixed():
    """Copies and near copies of every degree, and one passage that most texts share."""
    rnd = random.Random(8)
    passage = [f"p{k}" for k in range(120)]
    rows = []
    for k in range(60):
        own = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(20, 160))]
        base = passage + own if k % 3 else own
        rows += [(len(rows) * 3 % 1000 + n, " ".join(noisy(rnd, base, share))) for n, share in enumerate([0, 0, 0.005, 0.01, 0.02, 0.03][: rnd.randrange(1, 7)])]
    rnd.shuffle(rows)
    return rows


def test_equals_all_pairs(make_docs, mixed, odd):
    rows = mixed + [(i, t) for i, t in odd] + [(2000, "One two THREE"), (1999, "one two three"), (1998, "one two four")]
    assert got(make_docs(rows, extra=True)) == brute(rows)


def test_large_buckets_go_through_the_prefix_filter(make_docs, mixed, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    asked = []
    exact = near_dedup.similar_links
    monkeypatch.setattr(near_dedup, "similar_links", lambda *a: asked.append(1) or exact(*a))
    assert got(make_docs(mixed)) == brute(mixed) and asked


def test_empty_and_few(make_docs):
    assert got(make_docs([])) == []
    assert got(make_docs([(1, None), (None, " \n"), (5, "a b c d e f")])) == sorted([(1, 0, 1, True), (None, 0, None, True), (5, 2, 5, True)], key=str)


def test_recall_of_the_bands():
    """Of pairs at 0.85 nearly all share a band of both collections."""
    import numpy as np

    rnd = np.random.default_rng(1)
    met = 0
    for _ in range(400):
        pool = rnd.integers(0, 1 << 63, 200, np.int64).view(np.uint64)
        a, b = (minhash.bands(pool[s]).reshape(2, -1) for s in (slice(0, 185), slice(15, 200)))
        met += bool((a[0] == b[0]).any() and (a[1] == b[1]).any())
    assert met >= 399
