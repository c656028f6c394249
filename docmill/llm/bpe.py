"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoding reads a text in chunks. A splitter cuts it into pre-tokens; a pre-token
that outgrows a chunk is not gathered but streamed through :class:`MergeStream`,
which emits a token as soon as no later byte can change it. How far it has to
look ahead follows from the merge list alone (:meth:`Merges.lookahead`), so
memory is constant whatever the length of a text or of a run without blanks.
Decoding is a state machine from bytes to text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a splitter takes at once.
CHUNK = 1 << 16
#: Pre-tokens remembered per worker; the memory is emptied when full.
REMEMBERED = 500_000
#: Bytes of output gathered before a batch leaves a worker.
OUT_BYTES = 8 << 20

# White space of the Unicode property, the splitter's alternatives.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_RUNS = [regex.compile(p) for p in (rf"[{_SPACE}]+", r"\p{L}+", r"\p{N}+", rf"[^{_SPACE}\p{{L}}\p{{N}}]+")]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where visible, else the next free code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in visible}
    hidden = [b for b in range(256) if chr(b) not in out]
    return out | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """A vocabulary file of the byte-level kind, ready for use in a worker."""

    def __init__(self, content: str):
        spec = json.loads(content)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.byte_ids = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.rights = [(self.bytes[i], len(self.bytes[vocab[b]])) for i, (_, b) in zip(self.made, pairs, strict=True)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["content"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def lookahead(self) -> int:
        """Bytes after a boundary that can still decide whether it stays.

        A merge at a place can only be forestalled by an earlier-ranked merge
        that overlaps its right end or covers it, which may again be forestalled
        in the same way further right. Ranks fall along such a chain, so one
        pass in rank order finds the longest.
        """
        inside: dict[bytes, int] = {}  # part of an earlier merge -> bytes that may matter after the part
        starts: dict[bytes, int] = {}
        most = 1
        for text, right in self.rights:
            far = max([inside.get(text, 0), *(starts.get(text[k:], 0) for k in range(len(text)))])
            most = max(most, right + far)
            for j in range(1, len(text)):
                after = len(text) - j + far
                head = text[:j]
                if starts.get(head, 0) < after:
                    starts[head] = after
                for i in range(1, j):
                    part = text[i:j]
                    if inside.get(part, 0) < after:
                        inside[part] = after
        return most

    def merged(self, data: bytes) -> list[int]:
        """Ids of one pre-token: lowest rank first, leftmost among equals."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) > 48:
            return self._merged_long(ids)
        get, made, none = self.rank.get, self.made, len(self.made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        n, rank = len(ids), self.rank
        ids, nxt, prv = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            r, i, p = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != p[0] or j < 0 or ids[j] != p[1]:
                continue
            ids[i], ids[j] = self.made[r], -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if (q := (ids[i], ids[k])) in rank:
                    heapq.heappush(heap, (rank[q], i, q))
            if (h := prv[i]) >= 0 and (q := (ids[h], ids[i])) in rank:
                heapq.heappush(heap, (rank[q], h, q))
        return [t for t in ids if t >= 0]


class MergeStream:
    """Tokens of one long pre-token, emitted once stable."""

    def __init__(self, merges: Merges, lookahead: int):
        self.merges, self.lookahead, self.window = merges, lookahead, 4 * lookahead + 1024
        self.rest = bytearray()

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.window):
            self.rest += data[at : at + self.window]
            if len(self.rest) < self.window:
                continue
            end, sure = 0, len(self.rest) - self.lookahead
            for t in self.merges.merged(bytes(self.rest)):
                size = len(self.merges.bytes[t])
                if end + size > sure:
                    break
                end += size
                yield t
            del self.rest[:end]

    def finish(self) -> list[int]:
        out = self.merges.merged(bytes(self.rest))
        self.rest.clear()
        return out


class Encoder(dict):
    """The transducer; as a dict it remembers what pre-tokens become."""

    def __init__(self, content: str, lookahead: int | None = None, chunk: int = CHUNK):
        super().__init__()
        self.merges = Merges(content)
        self.lookahead = lookahead or self.merges.lookahead()
        self.chunk = chunk

    def __missing__(self, pre: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = array("I", self.merges.merged(pre.encode())).tobytes()
        if len(pre) <= 40:
            self[pre] = out
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, piece by piece."""
        special = self.merges.special
        if not any(s in text for s in special):
            yield from self._plain(text)
            return
        for part in self.merges.special_split.splititer(text):
            if part in special:
                yield array("I", [special[part]]).tobytes()
            elif part:
                yield from self._plain(part)

    def _plain(self, text: str) -> Iterator[bytes]:
        if len(text) <= self.chunk:
            yield b"".join(map(self.__getitem__, _SPLIT.findall(text)))
            return
        rest, run, stream = "", None, MergeStream(self.merges, self.lookahead)
        for at in range(0, len(text), self.chunk):
            buf, last = rest + text[at : at + self.chunk], at + self.chunk >= len(text)
            if run is not None:
                # Inside a pre-token that began in an earlier chunk. A blank run leaves its last blank to what follows.
                m = run.match(buf)
                end = m.end() if m else 0
                blank = run is _RUNS[0]
                whole = end == len(buf)
                if blank and not (whole and last):
                    end = max(0, end - 1)
                yield array("I", stream.feed(buf[:end].encode())).tobytes()
                rest = buf[end:]
                if whole and not last:
                    continue
                yield array("I", stream.finish()).tobytes()
                buf, run = rest, None
            done = 0
            for m in _SPLIT.finditer(buf):
                # Two further characters settle a match: a contraction has three.
                if not last and m.end() > len(buf) - 2:
                    break
                yield self[m.group()]
                done = m.end()
            rest = buf[done:]
            if not last and len(rest) >= self.chunk // 2:
                # One unfinished pre-token, unless it ended just before the chunk did.
                lead = rest[0] == " " and not rest.isspace()
                run = next((r for r in _RUNS if r.fullmatch(rest, lead)), None)
                if run is not None:
                    end = len(rest) - (run is _RUNS[0])
                    yield array("I", stream.feed(rest[:end].encode())).tobytes()
                    rest = rest[end:]


class Decoder:
    """Ids to text; bytes that form no character yet wait for the next ids."""

    def __init__(self, content: str):
        merges = Merges(content)
        self.bytes = [merges.bytes.get(i, b"") for i in range(max(merges.bytes) + 1)]

    def decode(self, ids: bytes) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        table = self.bytes
        for at in range(0, len(ids), 4 * CHUNK):
            piece = array("I", ids[at : at + 4 * CHUNK])
            yield state.decode(b"".join([table[i] for i in piece]))
        yield state.decode(b"", final=True)


_made: dict = {}


def once(kind, content: str, *args):
    """One instance per worker process."""
    key = (kind, hashlib.sha256(content.encode()).digest(), args)
    if key not in _made:
        _made[key] = kind(content, *args)
    return _made[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def flushed(batch: pa.RecordBatch, column: int, f, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``batch`` with ``f`` of a column in that column's place, in parts of bounded size."""
    first, out, held = 0, [], 0
    values = batch.column(column)
    for k in range(len(values)):
        out.append(y := f(values[k].as_py()))
        held += len(y)
        if held >= OUT_BYTES or k + 1 == len(values):
            part = [c.slice(first, len(out)) for c in batch.columns]
            part[column] = pa.array(out, schema.field(column).type)
            yield pa.RecordBatch.from_arrays(part, schema=schema)
            first, out, held = k + 1, [], 0


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row: ids as little-endian unsigned 32-bit integers in one binary.

    ``vocabulary`` is a path on the driver; its content (a file of fixed size)
    is broadcast. Null text counts as empty and has no ids. Ids of rows may be
    null or repeat; every row gives one row. Strings of special tokens in a text
    become these tokens. Further columns of ``docs`` don't matter.
    """
    content = read_vocabulary(vocabulary)
    lookahead = Merges(content).lookahead()
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        encoder = once(Encoder, shared.value, lookahead)
        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0), pa.field("ids", pa.binary())])
            yield from flushed(batch, 1, lambda text: b"".join(encoder.encode(text)), schema)

    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``text`` in place of the ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    others = [c for c in encoded.columns if c != ids_col]
    rows = encoded.select(*others, F.coalesce(encoded[ids_col], F.lit(b"")).alias("text"))

    def run(batches):
        decoder = once(Decoder, shared.value)
        schema = None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(k) for k in range(len(others))), pa.field("text", pa.string())])
            yield from flushed(batch, len(others), lambda ids: "".join(decoder.decode(ids)), schema)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "text string"]))
