"""Whole queries and the pipeline against plain Python."""

import collections
import math
import random
import re
import zlib

import corpus_pipeline
import pytest
from docmill.llm import language_id, packing, quality_rules, queries, sharding, simhash, toxicity
from pyspark.sql import functions as F
from test_dedup import LOWER, brute_fingerprint
from test_models import brute_measures
from test_near_dedup import brute_components

WORDS = {"en": "the cat sat with another hat and that was it", "de": "der hund und die katze auf nicht gewesen straße", "fr": "le chat est dans la maison avec une autre élève"}


def spoken(rnd, lang, n):
    w = WORDS[lang].split()
    return " ".join(rnd.choice(w) + rnd.choice(["", "", ",", "!"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, make_docs, tmp_path_factory):
    """Tables in which every stage has something to do."""
    rnd = random.Random(12)
    rows = []
    for i in range(240):
        lang = rnd.choice(list(WORDS))
        rows.append((i, " ".join(f"{rnd.choice(WORDS[lang].split())}{rnd.randrange(900)}" for _ in range(rnd.randrange(55, 150))), lang))
    rows += [(300 + i, re.sub(r"(?<!\S)[a-z]", lambda m: m[0].upper(), rows[i][1]) if i % 2 else rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(400 + i, rows[i][1] + f" tail{i}", rows[i][2]) for i in range(20)]
    rows += [(500 + i, rows[i][1] + " grobnak fool", rows[i][2]) for i in range(30, 70)]
    rows += [(600 + i, " ".join(f"w{k}x{i}###" for k in range(60)), "en") for i in range(30)]
    rows += [(700, None, None), (701, "", "en"), (702, "few words", "en"), (None, rows[5][1] + " own", "en"), (703, rows[6][1], None), (703, rows[6][1], None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    make_docs(rows, extra=True).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 0 if r[0] is not None and 600 <= r[0] < 700 else 1, 1 if r[0] is not None and 500 <= r[0] < 600 else 0) for r in rows if r[0] is not None and r[0] < 700]
    spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def plain_exact(rows):
    """Of equal texts, A-Z lower-cased, one row of the largest id stays; null ids lose to any id."""
    best = {}
    for i, t in rows:
        key = (t or "").translate(LOWER)
        if key not in best or (-1 if i is None else i) > (-1 if best[key][0] is None else best[key][0]):
            best[key] = (i, t)
    return list(best.values())


def plain_near(rows):
    """Of each component of similar texts, one row of the smallest id stays; null ids come last."""
    root = brute_components([(k, t) for k, (_, t) in enumerate(rows)])
    least = {}
    for k, r in enumerate(rows):
        if root[k] not in least or (r[0] is None, r[0] or 0) < (least[root[k]][0] is None, least[root[k]][0] or 0):
            least[root[k]] = r
    return list(least.values())


def test_pipeline_stages_take_effect(spark, corpus):
    path, _ = corpus
    columns = spark.read.parquet(f"{path}/documents.parquet").columns
    now = spark.read.parquet(f"{path}/documents.parquet")
    seen = [now.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialise(stage(spark, now, path))
        assert now.columns == columns, name
        seen.append(now.select("doc_id", "text").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "exact_dedup", "near_dedup", "packing"]
    rows, ids = [[tuple(r) for r in x] for x in seen], [{r.doc_id for r in x} for x in seen]
    assert {*range(600, 630), 700, 701, 702} == ids[0] - ids[1]
    assert ids[1] - ids[2] == set(range(530, 570))
    count = lambda x: collections.Counter(map(str, x))
    assert count(rows[3]) == count(plain_exact(rows[2])) and len(rows[2]) - len(rows[3]) >= 20
    assert count(rows[4]) == count(plain_near(rows[3])) and len(rows[3]) - len(rows[4]) >= 15
    packed = corpus_pipeline.run(spark, path).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == collections.Counter(i for i, _ in rows[4])
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        ends = [0, *(a + n for a, n in sorted(x))]
        assert [a for a, _ in sorted(x)] == ends[:-1] and ends[-1] <= 2048


def test_pipeline_of_empty_tables(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def plain_ranks(text):
    """A text's n-grams by frequency, then by value."""
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in text)
    c = collections.Counter()
    for w in letters.split():
        framed = f" {w} "
        c.update(w)
        c.update(framed[i : i + 2] for i in range(len(framed) - 1))
        c.update(framed[i : i + 3] for i in range(len(framed) - 2))
    value = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
    return sorted(c, key=lambda g: (-c[g], value(g))), c, value


def test_language_id_query_against_plain_ranks(spark, make_docs, tmp_path, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, spoken(rnd, lang, rnd.randrange(1, 60)), lang) for i, lang in enumerate(rnd.choices(list(WORDS), k=80))] + [(90, None, "en"), (91, "\U0001f600 12", "de"), (92, "der hund", None)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    counts, value = collections.defaultdict(collections.Counter), plain_ranks("")[2]
    for i, t, lang in rows:
        if not held[i] and lang:
            counts[lang].update(plain_ranks(t or "")[1])
    profiles = {k: {g: n for n, g in enumerate(sorted(c, key=lambda g: (-c[g], value(g)))[: language_id.PROFILE], 1)} for k, c in counts.items()}
    # Small blocks: n-grams over a block's edge count like others.
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert all(collections.Counter(language_id.grams(t).tolist()) == {value(g): n for g, n in plain_ranks(t)[1].items()} for _, t, _ in rows if t)
    monkeypatch.undo()
    for r in queries.op3_language_id(spark, str(tmp_path)).collect():
        own = plain_ranks(dict((i, t) for i, t, _ in rows)[r.doc_id] or "")[0][: language_id.LIST]
        want = ("und", 0.0)
        if own:
            far = {k: sum(min(abs(p.get(g, 10**9) - n), language_id.PROFILE) for n, g in enumerate(own, 1)) for k, p in profiles.items()}
            best = min(sorted(far), key=far.get)
            want = (best, 1 - far[best] / (language_id.PROFILE * len(own)))
        assert (r.lang_pred, r.held_out) == (want[0], held[r.doc_id]) and r.score == pytest.approx(want[1])


def naive_weight(text, lexicon, exceptions):
    plain = toxicity.folded(text)
    at = lambda e: [m.start() for m in re.finditer(f"(?={re.escape(e)})", plain)]
    spared = [(x, x + len(e)) for e in map(toxicity.folded, exceptions) if e.strip() for x in at(e)]
    return sum(w for e, w in lexicon for a in at(e) if not any(x <= a and a + len(e) <= y for x, y in spared))


def test_matcher_against_naive_search():
    rnd = random.Random(6)
    lexicon = ((" ab", 1.0), (" abc ", 2.0), (" b ", 4.0), (" ca", 8.0), (" bca", 16.0))
    exceptions = ("ab b", "b ca c", "abc", "c ab b a")
    matcher = toxicity.Matcher("", lexicon, exceptions)
    for _ in range(500):
        text = " ".join("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(30)))
        assert matcher.weigh(text)[0] == naive_weight(text, lexicon, exceptions)
    assert matcher.weigh("abc " * 200_000)[0] == 0


def test_toxicity_query_scores_by_its_curve(spark, corpus):
    path, rows = corpus
    train = {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 0}
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.train(docs, labels.filter(F.col("doc_id").isin(*train)))
    for r in queries.op9_toxicity(spark, path).collect():
        texts = {t or "" for i, t, *_ in rows if i == r.doc_id}
        want = [1 / (1 + math.exp(-max(-30.0, min(30.0, sum(b * x for b, x in zip(model.curve, toxicity.features(naive_weight(t, model.lexicon, model.exceptions), len(toxicity.folded(t).split())), strict=True)))))) for t in texts]
        assert any(r.score == pytest.approx(w) for w in want) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and r.doc_id not in train)


def plain_verdicts(rows, labels):
    """Base rules, the joint path of cutoffs for each stratum, and each rule's own cutoff."""
    measured = []
    for i, t, lang in rows:
        n, chars, symbols, dup, rep = brute_measures(t)
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        bare = "".join(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        shares = {
            "symbols": min(symbols / max(n, 1), 1), "dup_lines": dup / max(len(lines), 1), "repeated": rep / max(n, 1),
            "upper": sum(c.isupper() for c in bare) / max(chars, 1), "shouts": min(len(re.findall(r"!(?=[\x20\x09-\x0D]|$)", t or "")) / max(n, 1), 1),
        }
        measured.append((i, lang or "", n < 50 or 100 * rep > 50 * n, shares))
    known = [(s, labels[i], v) for i, s, failed, v in measured if not failed and i in labels]
    strata = {s: [k for k in known if k[0] == s] for s in {k[0] for k in known}} | {None: known}
    strata = {s: k for s, k in strata.items() if any(good for _, good, _ in k)}
    level, cutoffs = quality_rules.ERROR / max(len(strata), 1), {}
    for s, k in strata.items():
        good = [v for _, g, v in k if g]
        if (1 - quality_rules.RISK) ** len(good) > level:
            continue
        end = None
        for step in reversed(range(len(quality_rules.GRID))):
            x, n = sum(max(v.values()) > quality_rules.GRID[step] for v in good), len(good)
            tail = sum(math.comb(n, j) * quality_rules.RISK**j * (1 - quality_rules.RISK) ** (n - j) for j in range(x + 1)) if x < n * quality_rules.RISK else 1
            if tail > level:
                break
            end = step
        cutoffs[s] = {}
        for rule in measured[0][3]:
            for c in quality_rules.GRID[end:] if end is not None else ():
                over = [sum(v[rule] > c for _, g, v in k if g == want) for want in (True, False)]
                if over[0] <= over[1]:
                    cutoffs[s][rule] = c
                    break
    return [(i, not failed and not any(v[r] > c for r, c in cutoffs.get(s, cutoffs.get(None, {})).items())) for i, s, failed, v in measured]


def test_quality_query_against_plain_certification(spark, make_docs, tmp_path):
    rnd = random.Random(4)
    rows, labels = [], {}
    for i in range(900):
        lang = rnd.choice(["en"] * 5 + ["de", "de", "fr"])
        bad = rnd.random() < 0.2
        words = [f"word{rnd.randrange(4000)}" for _ in range(rnd.randrange(48, 80))]
        for _ in range(rnd.randrange(3 if not bad else 40)):
            k = rnd.randrange(len(words))
            words[k] = rnd.choice([words[k].upper(), words[k] + "!", "#" + words[k], words[k - 1], words[k] + "\nsame line\nsame line\n"])
        rows.append((i, " ".join(words), lang))
        if rnd.random() < 0.8:
            labels[i] = not bad
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(g), 0) for i, g in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.kept for r in queries.op6_quality_rules(spark, str(tmp_path)).collect()}
    want = dict(plain_verdicts(rows, labels))
    assert got == want and 0 < sum(not v for v in want.values()) < 400


def test_simhash_query_against_brute_force(spark, corpus):
    path, rows = corpus
    ids = [r for r in rows if r[0] is not None]
    marks = [brute_fingerprint(t) for _, t, *_ in ids]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            if (marks[x] ^ marks[y]).bit_count() <= 2:
                root[find(x)] = find(y)
    least = collections.defaultdict(lambda: 10**9)
    for x, (i, *_) in enumerate(ids):
        least[find(x)] = min(least[find(x)], i)
    want = collections.Counter((i, f"{marks[x]:016x}", least[find(x)]) for x, (i, *_) in enumerate(ids))
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, path).collect() if r.doc_id is not None)
    assert got == want


def test_hot_ties_spread(spark, make_docs, monkeypatch):
    """Rows that agree in everything still go to many ranges, pieces and groups."""
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    monkeypatch.setattr(sharding, "RANGE_ROWS", 1000)
    placed = sharding.shard_documents(same, 8)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2
    assert placed.groupBy("shard").agg((F.max("slot") + 1 == F.countDistinct("slot")).alias("ok")).filter("NOT ok").count() == 0
    monkeypatch.setattr(packing, "GROUP_DOCS", 1000)
    packed = packing.pack(same, queries.public_tokenizers.path("word_bpe_49k.json"), length=64, carry={})
    groups = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(groups) == 20 and max(groups) < 1400


def test_range_search_counts_cuts(spark):
    rnd = random.Random(1)
    for ranges in (1, 2, 3, 16, 37):
        cuts = sorted(rnd.sample(range(100), ranges - 1))
        df = spark.createDataFrame([(k, cuts) for k in [None, *range(-1, 101)]], "k long, cuts array<long>")
        for r in sharding.range_of(F.col("k"), "cuts", ranges, df).collect():
            assert r._range == (-1 if r.k is None else sum(c <= r.k for c in cuts))


def test_native_models_run_no_python(spark, corpus):
    path, _ = corpus
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    for df in (quality_rules.judge(docs, labels), sharding.shard_documents(docs), simhash.components(spark.createDataFrame([(1, 2)], "a long, b long"))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
