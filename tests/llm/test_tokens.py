"""BPE and packing against the tokenizers library and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankintel.llm import bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, sequence_id string"


def odd_texts(n=400):
    rng = random.Random(3)
    texts = ["", "<|endoftext|>a<|endoftext|>", "<|startoftext|> B", " \t\n b\x1c c\u3000d ", "a" * 50, "x'll DON'T '' \x85 e\u0301 日本語 🎉", "İ Σας straße ª²", "<|endof"]
    texts += ["".join(rng.choice(" \t\nab'sé日1=-_\u3000\x1fÉß\xa0") for _ in range(rng.randint(1, 60))) for _ in range(n)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 255), rng.randint(256, 0xD7FF)])) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    return texts


def test_encoder_equals_library_and_decodes_back():
    own, library = bpe.Encoder(BYTE), Tokenizer.from_file(BYTE)
    texts = odd_texts()
    ids = own.encode(texts)
    expected = library.encode_batch(texts, add_special_tokens=False)
    assert [list(i) for i in ids] == [e.ids for e in expected]
    assert [own.decode(i) for i in ids] == [library.decode(e.ids, skip_special_tokens=False) for e in expected]


def test_word_encoder_equals_library():
    own, library = packing.WordEncoder(WORD), Tokenizer.from_file(WORD)
    texts = odd_texts()
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_rows(spark):
    rows = [(1, "The cat", "x", "y"), (1, "The cat", "x", "y"), (2, None, None, None), (None, "", None, None)]
    df = bpe.round_trip(spark.createDataFrame(rows, SCHEMA), BYTE)
    got = sorted(((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in df.collect()))
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("", "The cat")}
    assert got == [(0, 0, digest[""]), (1, 2, digest["The cat"]), (1, 2, digest["The cat"]), (2, 0, digest[""])]
    encoded = bpe.encode(spark.createDataFrame(rows, SCHEMA), BYTE)
    assert sorted(r.text for r in bpe.decode(encoded, BYTE).collect()) == ["", "", "The cat", "The cat"]
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def checked(rows, docs, capacity):
    """Every piece is the right part of its document, and sequences are gapless and within capacity."""
    library, by_doc, by_sequence = Tokenizer.from_file(WORD), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in docs.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        parts = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        assert [p.start for p in parts] == list(range(0, len(ids), capacity))
        for p in parts:
            own = ids[p.start : p.start + capacity]
            assert (p.length, p.ids_crc32) == (len(own), zlib.crc32(own.tobytes()))
    assert not by_doc
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_pack_pieces(spark):
    rng = random.Random(5)
    docs = {i: " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randint(0, 40))) for i in range(150)} | {900: None, 901: "same same", 902: "same same"}
    df = spark.createDataFrame([(k, v, "c", "d") for k, v in docs.items()], SCHEMA)
    rows = packing.pack(df, WORD, capacity=16).collect()
    used = checked(rows, docs, 16)
    assert used <= -(-sum(r.length for r in rows) // 16) + 2
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def optimum(items, capacity):
    best = len(items)

    def put(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + items[at] <= capacity:
                bins[i] += items[at]
                put(at + 1, bins)
                bins[i] -= items[at]
        put(at + 1, bins + [items[at]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_finds_the_optimum(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(20, 60) for _ in range(10)), reverse=True)
    packed = packing.pack_counts(Counter(items), 100, nodes=5_000)
    assert packing.size_of(packed) == optimum(items, 100)
    used = Counter()
    for filling, times in packed:
        assert sum(length * copies for length, copies in filling) <= 100
        for length, copies in filling:
            used[length] += copies * times
    assert used == Counter(items)
