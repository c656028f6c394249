"""Language identification by rank-order profiles.

A profile lists a language's most frequent n-grams (one to three letters, words
set off by blanks) by rank. A document's own list is compared with each profile
by out-of-place distance: the sum of rank differences, with the full list length
for an n-gram that the profile lacks. The nearest profile names the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a language profile and in a document's list.
PROFILE, LIST = 400, 300
#: Characters that are folded at once.
BLOCK = 1 << 18
#: Most languages a model may have; with more the run stops rather than broadcast an unbounded table.
MAX_LANGUAGES = 2000
#: Characters of text whose n-gram counts a training task gathers before it passes them on.
FLUSH_CHARS = 4 << 20


def _letter_table() -> np.ndarray:
    """Lower-case form of each code point, 32 where it is no letter."""
    table = np.full(0x110000, 32, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_letters: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as integers, 21 bits a letter; blanks frame words and never stand alone or in the middle."""
    if not _letters:
        _letters.append(_letter_table())
    table, out = _letters[0], []
    # The last two characters before a block; n-grams that end in the block are its own.
    before = np.array([32], np.int64)
    for at in range(0, len(text) + BLOCK, BLOCK):
        part = text[at : at + BLOCK]
        # A blank after the last block ends the last word.
        low = table[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)].astype(np.int64) if part else np.array([32], np.int64)
        letter = low != 32
        low = np.concatenate((before, low[letter | np.concatenate((before[-1:] != 32, letter[:-1]))]))
        own = len(before)
        out.append(low[own:][low[own:] != 32])
        out.append(((low[:-1] << 21) | low[1:])[own - 1 :])
        a, b, c = low[:-2], low[1:-1], low[2:]
        three = ((a << 42) | (b << 21) | c)[max(own - 2, 0) :]
        out.append(three[b[max(own - 2, 0) :] != 32])
        before = low[-2:]
    return np.concatenate(out)


def ranked(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent values in order; ties by value."""
    if len(values) > most:
        # Ties at the edge are all kept for the final order.
        edge = np.partition(counts, len(counts) - most)[len(counts) - most]
        values, counts = values[counts >= edge], counts[counts >= edge]
    return values[np.lexsort((values, -counts))][:most]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """``lang, gram, place`` of every language's profile, from the whole texts of all rows whose language isn't null.

    At most ``size`` rows a language. N-gram counts are summed in the tasks
    before they are exchanged, and the most frequent are picked in two steps so
    that no task ranks all n-grams of a language.
    """
    rows = labelled.filter(labelled[lang_col].isNotNull()).select(labelled[lang_col].cast("string").alias("lang"), F.coalesce(labelled[text_col], F.lit("")).alias("text"))

    def count(batches):
        held: dict[str, list] = {}
        chars = 0

        def flushed():
            for lang, parts in held.items():
                values, counts = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(counts, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(sums)], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                t = text.as_py()
                held.setdefault(lang.as_py(), []).append(np.unique(grams(t), return_counts=True))
                chars += len(t)
                if chars >= FLUSH_CHARS:
                    yield from flushed()
                    held, chars = {}, 0
        yield from flushed()

    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    some = counts.withColumn("salt", F.pmod("gram", F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("r") <= size)
    best = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= size)
    return best.select("lang", "gram", "place")


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), length: int = LIST) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, with the ``carry`` columns between.

    ``score`` is how near the nearest profile is, 1 for the same order and 0 for
    no n-gram in common. Texts without a letter, empty or null, and all texts
    under a model without languages, get ``und`` and 0. Between profiles equally
    near, the first language by name wins. Ids may be null or repeat.

    ``profiles`` are at most :data:`PROFILE` rows a language and at most
    :data:`MAX_LANGUAGES` languages; that bound is checked before they are
    broadcast.
    """
    model = profiles.limit(PROFILE * MAX_LANGUAGES + 1).toPandas()
    if model["lang"].nunique() > MAX_LANGUAGES or len(model) > PROFILE * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(model["lang"].unique())
    known = np.unique(model["gram"].to_numpy(np.int64))
    size = PROFILE
    # places[k, g]: the rank of n-gram g in language k, -1 where it has none.
    places = np.full((len(langs), len(known) + 1), -1, np.int32)
    for k, lang in enumerate(langs):
        own = model[model["lang"] == lang]
        places[k, np.searchsorted(known, own["gram"].to_numpy(np.int64))] = own["place"].to_numpy(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((langs, known, places))
    rows = docs.select(docs[id_col].alias("doc_id"), *carry, F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def predict(text: str) -> tuple[str, float]:
        langs, known, places = shared.value
        values, counts = np.unique(grams(text), return_counts=True)
        if not len(values) or not langs:
            return "und", 0.0
        own = ranked(values, counts, length)
        at = np.searchsorted(known, own)
        at[(at >= len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        there = places[:, at]
        gap = np.where(there < 0, size, np.minimum(np.abs(there - np.arange(1, len(own) + 1)), size)).sum(axis=1)
        best = int(gap.argmin())
        return langs[best], float(1 - gap[best] / (size * len(own)))

    def run(batches):
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))
