import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docmill.llm import exact_dedup, line_dedup, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup_against_brute_force(make_docs, odd):
    got = exact_dedup.exact_dedup(make_docs(odd, extra=True)).collect()
    groups = {}
    for i, t in odd:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    want = []
    for i, t in odd:
        g = groups[(t or "").translate(LOWER)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_dedup_keeps_columns_and_empty_table(make_docs, odd):
    docs = make_docs(odd, extra=True)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2, 4, 5, 6, 7, 8, 9}
    assert exact_dedup.exact_dedup(make_docs([])).collect() == []


def brute_fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_fingerprints(make_docs, odd):
    got = simhash.fingerprints(make_docs(odd, extra=True)).collect()
    want = {(i, brute_fingerprint(t)) for i, t in odd}
    assert {(r.doc_id, r.fp % (1 << 64)) for r in got} == want


def test_ball_links_and_components_lose_nothing(spark):
    rnd = random.Random(4)
    points = set()
    for _ in range(60):
        p = rnd.getrandbits(64)
        points.add(p)
        for _ in range(rnd.randrange(6)):
            for _ in range(rnd.randrange(1, 4)):
                p ^= 1 << rnd.randrange(64)
            points.add(p)
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for j, b in enumerate(points[:i]):
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(signed[i]), find(signed[j])))
                parent[y] = x
    assert {p: roots.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_components_of_long_chains(spark):
    n = 300
    chain = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(2000 - i, 1999 - i) for i in range(50)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(chain).collect()}
    assert all(roots[i] == 0 for i in range(n + 1)) and all(roots[2000 - i] == 1950 for i in range(51))


def test_near_duplicates_of_odd_rows(make_docs, odd):
    docs = make_docs(odd, extra=True)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got[3] == got[4] == 3 and got[1] == got[2] == got[9] == 1
    assert simhash.drop_near_copies(docs).columns == docs.columns
    assert simhash.near_duplicates(make_docs([])).collect() == []
    base = " ".join(f"w{i}" for i in range(3000))
    near = make_docs([(1, base), (2, base + " tail"), (3, "quite another text of its own")])
    kept = {r.doc_id for r in simhash.drop_near_copies(near).collect()}
    close = (brute_fingerprint(base) ^ brute_fingerprint(base + " tail")).bit_count() <= 2
    assert kept == ({1, 3} if close else {1, 2, 3})


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_automaton_against_brute_force(spark):
    rnd = random.Random(3)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("é" * 40, "é" * 42)]
    for _ in range(300):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randrange(60)))
        b = list(a)
        for _ in range(rnd.randrange(5)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("w")).collect()
        assert [r for r in got if r.w != (edit_distance(r.a, r.b) <= edits)] == []


def edited(rnd, text, times):
    c = list(text)
    for _ in range(times):
        i = rnd.randrange(len(c))
        c[i : i + rnd.randrange(2)] = rnd.choice(["", "x", "yz"])
    return "".join(c)


def near_lines(a, b):
    return edit_distance(a, b) <= min(2, min(len(a), len(b)) // 12)


def brute_classes(lines):
    """The least line of each line's class."""
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lines = sorted(root)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= 2 and near_lines(a, b):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {x: find(x) for x in lines}


def test_line_links_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(9)
    lines = set()
    for _ in range(40):
        base = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(10, 70)))
        lines.update([base, *(edited(rnd, base, rnd.randrange(1, 4)) for _ in range(4))])
    # A family of one template: one word of each is changed, some by a letter or two.
    words = [f"word{chr(97 + i)}" for i in range(18)]
    for i in range(60):
        own = list(words)
        k = rnd.randrange(len(own))
        own[k] = own[k][:-1] + rnd.choice("uvw") if i % 3 else "".join(rnd.choice("pqrst") for _ in range(7))
        lines.add(" ".join(own))
    lines = sorted(x for x in lines if x.strip())
    want = {(a, b) for i, a in enumerate(lines) for b in lines[:i] if near_lines(a, b)}
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    for few, crowd in ((1000, 1000), (1, 1000), (1, 2)):
        # With few entries to a key, the crowded way is taken for many of them, and with small crowds their keys are refined.
        monkeypatch.setattr(line_dedup, "FEW", few)
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        found = line_dedup.occurrences(docs, "doc_id", "text")
        distinct = line_dedup.distinct_lines(found, 2)
        text = {r.no: r.line for r in line_dedup.texts_of(found, distinct, distinct.select("no")).collect()}
        got = {tuple(sorted((text[r.a], text[r.b]), reverse=True)) for r in line_dedup.line_links(found, distinct).collect()}
        assert len(want) > 100 and got <= want
        assert got == want if crowd > 2 else brute_roots(lines, got) == brute_roots(lines, want)


def brute_roots(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("head, tail", [("", " end of it"), ("the same first words of ", " and the same last words")])
def test_lines_of_a_template_by_refined_keys(spark, monkeypatch, head, tail):
    """Dense families: rests of crowded keys get so short that they meet by deletions, for one and two edits and lengths at the border."""
    rnd = random.Random(4)
    lines = sorted({head + edited(rnd, "abbabaabbaba", rnd.randrange(1, 4)) + tail for _ in range(150)})
    want = {(a, b) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= 2 and near_lines(a, b)}
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "FEW", 1)
    monkeypatch.setattr(line_dedup, "CROWD", 1)
    found = line_dedup.occurrences(docs, "doc_id", "text")
    distinct = line_dedup.distinct_lines(found, 2)
    text = {r.no: r.line for r in line_dedup.texts_of(found, distinct, distinct.select("no")).collect()}
    got = {tuple(sorted((text[r.a], text[r.b]), reverse=True)) for r in line_dedup.line_links(found, distinct).collect()}
    assert got <= want and len(want) > 100
    assert brute_roots(lines, got) == brute_roots(lines, want)


def test_line_signatures_bound_edits(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(300):
        a = "".join(rnd.choice("abé d") for _ in range(rnd.randrange(24, 60)))
        rows.append((a, edited(rnd, a, 1)[: len(a) + 1]))
    df = spark.createDataFrame(rows, "a string, b string")
    far = df.select("a", "b", F.bit_count(line_dedup.signature(F.col("a")).bitwiseXOR(line_dedup.signature(F.col("b")))).alias("bits")).collect()
    assert all(r.bits <= line_dedup.PAIRS_PER_EDIT * edit_distance(r.a, r.b) for r in far)


def test_line_dedup_of_documents(make_docs, odd):
    near = "this line is long enough to be compared"
    docs = make_docs([(1, f"{near}\nshort\n\nshort"), (2, f"own line\n{near}!\nshort"), (3, None), (None, near)], extra=True)
    got = {r.doc_id: (r.n_lines, r.dropped) for r in line_dedup.dropped_lines(docs).collect()}
    assert got == {1: (3, [3]), 2: (3, [1, 2]), 3: (0, []), None: (1, [0])}
    cut = {r.doc_id: r.text for r in line_dedup.drop_near_lines(docs).collect()}
    assert cut == {1: f"{near}\nshort\n", 2: "own line", 3: None, None: ""}
    assert line_dedup.drop_near_lines(docs).columns == docs.columns
    assert line_dedup.dropped_lines(make_docs([])).collect() == []
    assert line_dedup.dropped_lines(make_docs(odd, extra=True)).count() == len(odd)


def test_line_dedup_of_repeated_rows_and_ids(make_docs):
    docs = make_docs([(1, "one line of its own here"), (1, "one line of its own here"), (1, "another text\none line of its own here")])
    got = sorted((r.n_lines, r.dropped) for r in line_dedup.dropped_lines(docs).collect())
    assert got == [(1, []), (1, [0]), (2, [1])]
    assert sorted(r.text for r in line_dedup.drop_near_lines(docs).collect()) == ["", "another text", "one line of its own here"]


def test_line_dedup_query_against_brute_force(spark, make_docs, tmp_path):
    from docmill.llm.queries import op10_line_dedup

    rnd = random.Random(5)
    pool = ["".join(rnd.choice("abcde fgh") for _ in range(rnd.randrange(3, 50))) + "z" for _ in range(30)]
    rows = [(i, "\n".join(edited(rnd, rnd.choice(pool), rnd.randrange(3)) for _ in range(rnd.randrange(6)))) for i in range(60)]
    make_docs([*rows, (60, None), (61, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip()]
    classes, seen, want = brute_classes([x for *_, x in lines]), set(), {i: (0, []) for i in range(62)}
    for i, k, x in lines:
        n, gone = want[i]
        want[i] = (n + 1, gone + [k] if classes[x] in seen else gone)
        seen.add(classes[x])
    got = {r.doc_id: (r.n_lines, [int(x) for x in r.dropped.split(",") if x]) for r in op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == want


def test_native_operators_run_no_python(make_docs):
    docs = make_docs([(1, "a b c"), (2, "d e f")])
    for df in (exact_dedup.exact_dedup(docs), line_dedup.dropped_lines(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_masks_are_the_ball():
    assert len(simhash.masks(1)) == 65 and len(set(simhash.masks(2))) == 1 + 64 + 64 * 63 // 2
    assert all(bin(int(np.uint64(m % (1 << 64)))).count("1") <= 1 for m in simhash.masks(1))
