import random

from docmill.operators import sheets


def test_most_similar_line_counts_empty_places(spark):
    rnd = random.Random(5)
    base = [("g", 1, ["B", "C", "D"]), ("g", 2, ["B", "", ""])]
    collect = [("g", 1, ["A", "", ""])]
    for i in range(1, 25):
        for rows in (base, collect):
            rows.append(("h", i, [rnd.choice([None, "", " ", "x", "y", "z"]) for _ in range(rnd.randrange(2, 6))]))
    text = lambda line, k: (line[k] or "").strip() if k < len(line) else ""
    want = {}
    for g, i, c in collect:
        best = (1, 0.0)
        for h, j, b in base:
            n = max(len(b), len(c))
            s = sum(text(b, k) == text(c, k) for k in range(n)) / n
            if h == g and s > best[1]:
                best = (j, s)
        want[g, i] = best
    frames = [spark.createDataFrame(x, "g string, line long, cells array<string>") for x in (base, collect)]
    got = {(r.g, r.line): (r.base_line, r.similarity) for r in sheets.most_similar_line(*frames, ["g"]).collect()}
    assert got == want and got["g", 1] == (2, 2 / 3)


def test_frequent_values_and_blanks_equal_the_plain_loop(spark, monkeypatch):
    import random

    from docmill.operators import sheets

    monkeypatch.setattr(sheets, "RARE", 2)
    rnd = random.Random(3)
    line = lambda: [rnd.choice(["hot", "hot", "", " ", None, "b", f"v{rnd.randrange(12)}"]) for _ in range(rnd.randrange(1, 5))]
    base, told = [(g, i + 1, line()) for g in range(3) for i in range(40)], [(g, i + 1, line()) for g in range(4) for i in range(30)]
    got = sheets.most_similar_line(*(spark.createDataFrame(x, "g int, line long, cells array<string>") for x in (base, told)), ["g"])
    text = lambda x: (x or "").strip()
    want = []
    for g, i, c in told:
        best = (0.0, 1)
        for h, j, b in base:
            n = max(len(b), len(c))
            s = sum(text(x) == text(y) for x, y in zip(b + [None] * (n - len(b)), c + [None] * (n - len(c)), strict=True)) / n
            if h == g and s > best[0]:
                best = (s, j)
        want.append((g, i, best[1], best[0]))
    assert sorted(map(tuple, got.collect())) == sorted(want)
