"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps homoglyphs, accents, full-width and styled letters and digit
substitutions to plain letters, so disguised spellings meet the same entry. The
lexicon holds words and word beginnings with log-odds weights learned from
labelled documents. A document's weights are summed outside of exception
phrases; the sum and the length give a probability by logistic regression.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.bpe import once
from docmill.storage import materialise

#: Labelled documents that a model is fitted on at most, picked by a hash of their id.
TRAINING_ROWS = 20_000
#: Entries of a lexicon at most, and candidates that are looked at for it.
LEXICON, CANDIDATES = 2_000, 50_000
#: A word beginning counts from so many letters; longer words count as wholes too.
STEMS = range(4, 10)
#: An entry needs so many toxic documents, and this much evidence (standard errors of its log-odds).
MIN_DOCS, MIN_Z = 3, 3.5
#: Patterns a training task counts before it passes them on.
HELD = 120_000
#: Documents without a toxic label that an exception phrase must occur in, and phrases learned at most.
HARMLESS, PHRASES = 5, 2_000

# Look-alike letters of other scripts, digits and signs that stand for letters, harmless phrases.
LOOKALIKES = dict(zip("асеорхуіјѕԁһмтквнгαβεικνορτυχω", "aceopxyijsdhmtkbhrabeiknoptuxw", strict=True)) | {"ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "€": "e", "£": "l"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "class clown", "pathetic fallacy", "idiot light", "pond scum")
TOP = 0x1F000

_tables: list = []


def _tabled() -> tuple[np.ndarray, np.ndarray]:
    """For code points below ``TOP``: the folded letter, 32 for a gap, 0 for nothing; and which are signs."""
    if not _tables:
        fold, sign = np.full(TOP, 32, np.uint32), np.zeros(TOP, bool)
        for c in range(TOP):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            base = unicodedata.normalize("NFKD", ch)[0].lower()[0]
            base = LOOKALIKES.get(base, DIGITS.get(base, base))
            if ch in SIGNS:
                fold[c], sign[c] = ord(SIGNS[ch]), True
            elif unicodedata.category(ch) in ("Mn", "Cf"):
                fold[c] = 0
            elif base.isalpha():
                fold[c] = ord(base)
        _tables.extend((fold, sign))
    return _tables[0], _tables[1]


def folded(text: str) -> str:
    """Letters only, words set off by single blanks, a blank at either end. A sign stands for a letter only before one."""
    fold, sign = _tabled()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(codes, TOP - 1)
    out = np.where(codes < TOP, fold[low], np.uint32(32))
    signs = sign[low] & (codes < TOP)
    if signs.any():
        letter = (out > 32) & ~signs
        before = np.concatenate((letter[1:], [False]))
        out = np.where(signs & ~before, np.uint32(32), out)
    out = out[out != 0]
    out = np.concatenate((np.array([32], np.uint32), out, np.array([32], np.uint32)))
    keep = np.concatenate(([True], (out[1:] != 32) | (out[:-1] != 32)))
    return out[keep].tobytes().decode("utf-32-le")


@dataclass(frozen=True)
class Model:
    """Entries begin with a blank; those that end with one are whole words. ``curve``: intercept, per log of weight, per log of words."""

    lexicon: tuple[tuple[str, float], ...]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    """The automaton of a lexicon and of its exception phrases."""

    def __init__(self, key: str, lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon:
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            spelled = folded(phrase)
            if spelled.strip():
                self.automaton.add_word(spelled, (len(spelled), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def holds(self, word: str) -> bool:
        """Whether a folded word holds an entry."""
        return bool(len(self.automaton)) and next(iter(self.automaton.iter(f" {word} ")), None) is not None

    def weigh(self, text: str) -> tuple[float, int]:
        """Sum of the weights outside exception phrases, and the number of words."""
        plain = folded(text)
        words = max(0, plain.count(" ") - 1)
        hits, spared = [], []
        if len(self.automaton):
            for end, (size, weight) in self.automaton.iter(plain):
                (spared if weight is None else hits).append((end - size + 1, end, weight))
        # Both lists come by end. From the last hit on, the earliest start of the phrases that end no sooner tells whether one holds the hit.
        total, start = 0.0, len(plain)
        for a, b, w in reversed(hits):
            while spared and spared[-1][1] >= b:
                start = min(start, spared.pop()[0])
            if start > a:
                total += w
        return total, words


def features(total: float, words: int) -> tuple[float, float, float]:
    """Without a hit the length says nothing."""
    return 1.0, math.log1p(total), math.log1p(words) if total > 0 else 0.0


def probability(curve: tuple[float, float, float], total: float, words: int) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(b * x for b, x in zip(curve, features(total, words), strict=True))))))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """``toxic, text`` of the labelled documents whose ids hash lowest, at most ``rows``.

    A document with several labels takes the highest, an id of several rows its least text.
    """
    ones = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most ``rows`` pairs of numbers: small enough to broadcast.
    some = ones.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_id")
    texts = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    met = texts.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.first("toxic").cast("int").alias("toxic"), F.min("text").alias("text"))
    return met.select("toxic", "text")


def learn_lexicon(sample: DataFrame) -> tuple[tuple[str, float], ...]:
    """Words and word beginnings that set toxic documents apart, strongest first, none the beginning of another."""

    def count(batches):
        seen: Counter = Counter()

        def flushed():
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["entry", "toxic", "n"])

        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
                words, y = set(folded(text.as_py()).split()), toxic.as_py()
                entries = {f" {w} " for w in words if len(w) >= 3}
                for k in STEMS:
                    entries.update({" " + w[:k] for w in words if len(w) >= k})
                entries.add("")
                seen.update([(e, y) for e in entries])
                if len(seen) >= HELD:
                    yield from flushed()
                    seen.clear()
        yield from flushed()

    counts = sample.mapInArrow(count, "entry string, toxic int, n bigint").groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("good")
    )
    counts = materialise(counts.filter((F.col("bad") >= MIN_DOCS) | (F.col("entry") == "")))
    whole = counts.filter("entry = ''").first()
    if whole is None or not whole["bad"] or not whole["good"]:
        return ()
    weight = F.log((F.col("bad") + 0.5) / (whole["bad"] + 1)) - F.log((F.col("good") + 0.5) / (whole["good"] + 1))
    sure = weight / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    gain = F.col("bad") * weight
    found = counts.filter("entry <> ''").select("entry", weight.alias("weight"), sure.alias("z"), gain.alias("gain")).filter((F.col("z") >= MIN_Z) & (F.col("weight") >= 1.5))
    # Bounded: the best candidates only, of which a lexicon takes fewer still.
    best = found.orderBy(F.desc("gain"), F.desc(F.length("entry")), "entry").limit(CANDIDATES).collect()
    taken: dict[str, float] = {}
    begun: set[str] = set()
    for row in best:
        e = row["entry"]
        if len(taken) < LEXICON and e not in begun and not any(e[:k] in taken for k in range(1, len(e))):
            taken[e] = float(row["weight"])
            begun.update(e[:k] for k in range(1, len(e) + 1))
    return tuple(taken.items())


def learn_exceptions(sample: DataFrame, lexicon: tuple[tuple[str, float], ...]) -> tuple[str, ...]:
    """Pairs of neighbouring words of which one holds a lexicon entry, and that only documents without a toxic label have: at least HARMLESS of them.

    At most PHRASES pairs, the most frequent first.
    """

    def count(batches):
        matcher = Matcher("", lexicon, ())
        seen: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
                words, y = folded(text.as_py()).split(), toxic.as_py()
                hit = [matcher.holds(w) for w in words]
                seen.update([(p, y) for p in {f"{a} {b}" for a, b, c, d in zip(words, words[1:], hit, hit[1:], strict=False) if c or d}])
                if len(seen) >= HELD:
                    yield counted(seen)
                    seen.clear()
        yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["phrase", "toxic", "n"])

    pairs = sample.mapInArrow(count, "phrase string, toxic int, n bigint").groupBy("phrase").agg(F.sum("n").alias("n"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return tuple(r["phrase"] for r in pairs.filter((F.col("toxic") != 1) & (F.col("n") >= HARMLESS)).orderBy(F.desc("n"), "phrase").limit(PHRASES).collect())


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", exceptions: tuple[str, ...] = EXCEPTIONS, rows: int = TRAINING_ROWS) -> Model:
    """Fit lexicon, exception phrases (besides those given) and curve on at most ``rows`` labelled documents.

    Labels with null in ``doc_id`` or ``toxic`` and labels of no document say
    nothing. Without toxic or without other documents the lexicon is empty and
    every score is the share of toxic labels, 0.5 without any.
    """
    sample = materialise(training_sample(docs, labels, id_col, text_col, rows))
    lexicon = learn_lexicon(sample)
    if lexicon:
        exceptions = tuple(dict.fromkeys((*exceptions, *learn_exceptions(sample, lexicon))))

    def weigh(batches):
        matcher = Matcher("", lexicon, exceptions)
        for batch in batches:
            rows = [(*matcher.weigh(t.as_py()), y.as_py()) for y, t in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int32()))], names=["total", "words", "toxic"])

    # Three numbers for each of at most ``rows`` documents.
    seen = sample.mapInArrow(weigh, "total double, words bigint, toxic int").toPandas()
    if seen.empty:
        return Model((), (0.0, 0.0, 0.0), exceptions)
    x = np.array([features(t, w) for t, w in zip(seen["total"], seen["words"], strict=True)])
    return Model(lexicon, fit_curve(x, (seen["toxic"].to_numpy() == 1).astype(float)), exceptions)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the ``carry`` columns, ``score`` and ``predicted`` for every row of ``docs``.

    Null text counts as empty; empty texts score like others without a hit. Ids
    may be null or repeat.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), *carry, F.coalesce(docs[text_col], F.lit("")).alias("text"))
    key = repr(model)

    def run(batches):
        matcher = once(Matcher, key, model.lexicon, model.exceptions)
        for batch in batches:
            scores = [probability(model.curve, *matcher.weigh(t.as_py())) for t in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def predictor(model: Model):
    """A pandas UDF from text to ``predicted``: rows stay where they are, only the text travels to Python."""
    key = repr(model)

    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = once(Matcher, key, model.lexicon, model.exceptions)
        for texts in parts:
            yield pd.Series([int(probability(model.curve, *matcher.weigh(t or "")) >= 0.5) for t in texts], dtype="int32")

    return F.pandas_udf(predict, "int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`score` predicts to be toxic; same columns."""
    return docs.filter(predictor(model)(docs[text_col]) == 0)
