import random

from docmill.llm import near_dedup


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = {i: sets(t) for i, t in rows}
    for i in s:
        for j in s:
            if i < j and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in s}


def test_near_dedup_against_brute_force(spark, make_docs):
    rnd = random.Random(8)
    rows = [(0, None), (1, " \t"), (2, "Few words"), (3, "few  WORDS")]
    for g in range(40):
        base = [f"g{g}w{rnd.randrange(500)}" for _ in range(rnd.randrange(60, 400))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            c = list(base)
            # A replaced word changes five shingles: similarities from 0.7 to 0.97.
            for k in range(1, rnd.randrange(2, 6 + len(base) // 40)):
                c[rnd.randrange(len(c))] = f"x{g}y{k}"
            rows.append((len(rows), " ".join(c)))
    want = brute_components(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(make_docs(rows, extra=True)).collect()}
    assert got == want and len(set(want.values())) < len(rows) - 40


def test_pipeline_stage_drops_near_copies(spark, make_docs):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[corpus_pipeline.STAGES[3][0]]
    base = [f"w{i}" for i in range(300)]
    changed = [("other" if i in (50, 120, 200, 260) else w) for i, w in enumerate(base)]
    docs = make_docs([(1, " ".join(base)), (2, " ".join(changed)), (3, "quite another text"), (None, None)])
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, None}
    assert near_dedup.near_duplicates(make_docs([])).collect() == []
