import random
import zlib
from array import array

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docmill.llm import bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b", "É", "th", "er", "ing", " ", "  ", "\n", "'", "s", "'re", "é", "ß", "1", "23", "!", "--", ",", ".", "===", "\t", "日本", "😀", " ", "　", "\x1c", "\x85", "́", "Σ", "İ", " the", "THE", "<|endoftext|>"]


def texts(seed, n=600):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(n)]
    return out + ["=" * 5000 + " " * 300 + "x", "ab" * 4000, "' " * 900, ""]


def test_transducer_equals_the_library_at_any_chunk_size():
    content, t = bpe.read_vocabulary(BYTE), Tokenizer.from_file(BYTE)
    lookahead = bpe.Merges(content).lookahead()
    decoder = bpe.Decoder(content)
    for chunk in (8, 33, 1 << 16):
        encoder = bpe.Encoder(content, lookahead, chunk)
        for text in texts(chunk):
            ids = b"".join(encoder.encode(text))
            want = t.encode(text, add_special_tokens=False).ids
            assert list(array("I", ids)) == want
            assert "".join(decoder.decode(ids)) == t.decode(want, skip_special_tokens=False)


def test_decoder_replaces_what_is_no_text():
    content, t = bpe.read_vocabulary(BYTE), Tokenizer.from_file(BYTE)
    decoder, rnd = bpe.Decoder(content), random.Random(1)
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(rnd.randrange(30))]
        assert "".join(decoder.decode(array("I", ids).tobytes())) == t.decode(ids, skip_special_tokens=False)


def test_round_trip_of_odd_rows(make_docs, odd):
    encoded = bpe.encode_documents(make_docs(odd, extra=True), BYTE)
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode_documents(encoded, BYTE).collect())
    assert back == sorted((str(i), t or "") for i, t in odd)
    assert bpe.encode_documents(make_docs([]), BYTE).collect() == []


def test_word_ids_equal_the_library():
    words, t = packing.WordIds(bpe.read_vocabulary(WORD)), Tokenizer.from_file(WORD)
    for text in texts(5, 3000):
        assert list(array("I", words.encode(text))) == t.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_equals_plain_first_fit():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 400):
        sizes = rnd.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], np.zeros(n, int)
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            if sizes[i] == 100:
                continue
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
            if k is None:
                k = len(room)
                room.append(100)
            room[k] -= sizes[i]
            want[i] = k
        part = sizes != 100
        assert (bins[part] == want[part]).all()
        for b in set(bins.tolist()):
            inside = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in inside] == [sum(s for _, s in inside[:k]) for k in range(len(inside))] and sum(s for _, s in inside) <= 100


def test_packing_places_every_id_once(make_docs, odd):
    packed = packing.pack(make_docs(odd, extra=True), WORD, length=64).collect()
    t = Tokenizer.from_file(WORD)
    want = sorted(zlib.crc32(array("I", t.encode(x or "", add_special_tokens=False).ids + [1]).tobytes()) for _, x in odd)
    by_doc, used = {}, {}
    for r in packed:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 64
    found = []
    for (_, n), rows in by_doc.items():
        copies = sum(r.start == 0 for r in rows)
        assert sum(r.length for r in rows) == n * copies
        if copies == 1:
            found.append(zlib.crc32(b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.start))))
    assert set(found) <= set(want)
    assert packing.pack(make_docs([]), WORD).collect() == []


def test_packing_wastes_little(make_docs):
    rnd = random.Random(3)
    docs = make_docs([(i, " ".join(rnd.choice(["the", "cat", "sat", "mat"]) for _ in range(rnd.randrange(5, 400)))) for i in range(600)])
    total = packing.pack(docs, WORD, length=256, carry={}).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert total.n / (total.s * 256) > 0.98
