"""Packing by first-fit decreasing in randomised groups of documents.

Documents are tokenised where they are read, cut at multiples of the sequence
length, and only the pieces' rows travel: each randomised group of a few
thousand documents is packed by itself. A tournament tree over the bins'
remaining room finds the first bin that fits in logarithmic time.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.bpe import OUT_BYTES, byte_alphabet, once, read_vocabulary
from docmill.storage import materialise

#: Documents to a group, about.
GROUP_DOCS = 4096
#: Words remembered per worker; the memory is emptied when full.
REMEMBERED = 300_000


#: Signs at a word's end, after an ASCII or Latin-1 letter or a digit.
_TAIL = re.compile(rb"([a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf])([!-/:-@\[-`{-~]+)(?=[\t-\r ]|\Z)")


class WordIds(dict):
    """Ids of blank-separated words by the tokenizers library, remembered as little-endian unsigned 32-bit integers.

    The vocabulary's splitter never joins across blanks, so a text's ids are its
    words' ids in a row. It lower-cases, and parts letters from the signs after
    them; doing both here first lets many words share an entry. Texts where
    that could differ (special tokens, letters whose lower case depends on
    their place, decomposed letters) are left as they are.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.visible = {b: c for c, b in byte_alphabet().items()}

    def encode(self, text: str) -> bytes:
        plain = text.isascii() or ("Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text))
        if plain and "<|" not in text:
            words = _TAIL.sub(rb"\1 \2", text.lower().encode("utf-8", "replace")).split()
        else:
            words = text.encode("utf-8", "replace").split()
        new = [w for w in set(words) if w not in self]
        if new:
            if len(self) + len(new) > REMEMBERED:
                self.clear()
                new = list(set(words))
            spelled = {w: w.decode() for w in new}
            # A word of lower-case letters is one piece of the splitter: the merges alone decide.
            letters = {w for w, s in spelled.items() if plain and s.isalpha() and s == s.lower()}
            for w in letters:
                piece = spelled[w] if w.isascii() else "".join([self.visible[b] for b in w])
                self[w] = array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()
            rest = [w for w in new if w not in letters]
            for w, e in zip(rest, self.tokenizer.encode_batch_fast([spelled[w] for w in rest], add_special_tokens=False), strict=True):
                self[w] = array("I", e.ids).tobytes()
        return b"".join(map(self.__getitem__, words))


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; sizes from 1 to ``room``."""
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole = np.flatnonzero(sizes == room)
    rest = np.flatnonzero(sizes != room)
    rest = rest[np.argsort(-sizes[rest], kind="stable")]
    leaves = 1 << max(0, int(len(rest) - 1).bit_length())
    tree = [room] * (2 * leaves)  # node k: the most room of its bins; leaves are bins in order
    used = 0
    for i, size in zip(rest.tolist(), sizes[rest].tolist(), strict=True):
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        bins[i], offsets[i] = k - leaves, room - tree[k]
        used = max(used, k - leaves + 1)
        tree[k] -= size
        while k > 1:
            k //= 2
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a >= b else b
    bins[whole] = used + np.arange(len(whole))
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_no, start, length, doc_tokens, ids``: every document's ids, cut at multiples of ``length``.

    ``row_no`` tells rows of equal ids apart. ``vocabulary`` is a path on the driver; its content (a file of fixed size)
    is broadcast. Null and empty texts are the end id only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end = array("I", [end_id]).tobytes()
    rows = docs.select(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches):
        words = once(WordIds, shared.value)
        for batch in batches:
            kind = batch.schema.field(0).type
            out: tuple[list, ...] = ([], [], [], [], [], [])
            held = 0
            for doc, row, text in zip(*batch.columns, strict=True):
                ids = words.encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc.as_py(), row.as_py(), start, len(part) // 4, total, part), strict=True):
                        column.append(value)
                    held += len(part)
                if held >= OUT_BYTES:
                    yield batch_of(kind, out)
                    out, held = ([], [], [], [], [], []), 0
            if held:
                yield batch_of(kind, out)

    def batch_of(kind, out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], kind), *(pa.array(c, pa.int64()) for c in out[1:5]), pa.array(out[5], pa.binary())], names=names)

    names = ["doc_id", "row_no", "start", "length", "doc_tokens", "ids"]
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_no bigint, start bigint, length bigint, doc_tokens bigint, ids binary")


def pack(
    docs: DataFrame,
    vocabulary: str,
    length: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Column] | None = None,
    seed: int = 7,
) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids.

    Returns one row per piece: ``doc_id, start, length, doc_tokens,
    sequence_id, offset`` and the ``carry`` columns, by default ``ids``
    themselves (little-endian unsigned 32-bit integers). ``carry`` may derive
    columns from a piece before anything is shuffled.

    Null and empty texts are packed as their end id. Null and repeated ids and
    repeated rows are packed like others; rows are dealt to groups by their
    place, so that no id gathers in one group. Pieces are written to the shared
    folder first, so that a row's place stays the same. An empty table gives no
    rows.
    """
    carry = {"ids": F.col("ids")} if carry is None else carry
    cut = pieces(docs, vocabulary, length, end_id, id_col, text_col)
    cut = materialise(cut.select("doc_id", "row_no", "start", "length", "doc_tokens", *(v.alias(k) for k, v in carry.items())))
    groups = -(-cut.filter("start = 0").count() // GROUP_DOCS) or 1
    cut = cut.withColumn("group_no", F.pmod(F.xxhash64(F.lit(seed), F.col("row_no")), F.lit(groups)))

    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row_no", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.drop(columns=["group_no", "row_no"]).assign(sequence_id=rows["group_no"].to_numpy() * (1 << 32) + bins, offset=offsets)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name not in ("group_no", "row_no")]
    return cut.groupBy("group_no").applyInPandas(placed, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))
