"""Pipeline stages on tables whose extra columns clash, the bounds of the encoder and of a fit, and turns without a number."""

import tracemalloc

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from rankintel.llm import chat, language, packing

CLASHES = ("good", "score", "lang_pred", "__text", "id", "row", "at", "rank", "hashes", "packed", "rest", "n")


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"The quick brown fox number {i} jumps over the lazy dog and then the other dog of number {i} again.", "en", "s", 90) for i in range(40)]
    rows += [(40, rows[3][1], "en", "s", 90), (41, None, "en", "s", 0), (None, rows[5][1], None, "s", 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in CLASHES})
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.language_stage, corpus_pipeline.near_duplicate_stage, corpus_pipeline.substring_stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[c] == c for r in kept for c in CLASHES)
        assert {r.doc_id for r in kept} <= {r[0] for r in rows}
    empty = docs.limit(0)
    assert corpus_pipeline.quality_stage(spark, empty, "").count() == corpus_pipeline.language_stage(spark, empty, "").count() == 0


def test_an_encoder_holds_no_more_than_its_bound(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    small = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"word{i}x{j}, Ünï{i}" for j in range(40)) for i in range(60)]
    got = []
    for text in texts:
        got.append(small.encode(text))
        assert small.held <= 20_000 + 3 * packing.ENTRY_BYTES
    monkeypatch.setattr(packing, "CACHE_BYTES", 1 << 40)
    large = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert got == [large.encode(text) for text in texts]


def test_an_encoder_remembers_a_word_once():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    words = [f"{a}{b}{c}tion" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    ids = encoder.encode(" ".join(words))
    assert len(words) * packing.ENTRY_BYTES < encoder.held < 1.5 * len(words) * packing.ENTRY_BYTES
    held = encoder.held
    assert encoder.encode("\n".join(words)) == ids and encoder.held == held


def test_a_fit_holds_no_copies_of_its_rows():
    rng = np.random.default_rng(4)
    rows = rng.random((400, language.FEATURES)).astype(np.float32)
    side = np.where(np.arange(400) % 3 == 0, 1.0, -1.0)
    rows[side > 0, 7] += 5
    own = rows.copy()
    tracemalloc.start()
    weights, bias = language._machine(own, side, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows.nbytes
    assert ((rows @ weights + bias > 0) == (side > 0)).all()


def test_shares_of_a_text_are_sent_without_zeros():
    texts = ["a", "The quick brown fox", "日本語 é", "x" * 3000]
    packed = [language._packed(text) for text in texts]
    for text, own, row in zip(texts, packed, language._unpacked(packed)):
        found = np.bincount(language._triples(text), minlength=language.FEATURES)
        assert (row == (found / found.sum()).astype(np.float32)).all()
        assert len(own) <= 6 * len(set(language._triples(text).tolist()))


def test_turns_without_a_number_come_first(spark):
    turns = spark.createDataFrame([("c", -100, "a", "minus"), ("c", None, "b", "null"), ("c", 0, "a", "zero"), ("c", 200, "b", "last")], "conv_id string, turn int, role string, text string")
    shown = chat.rotate(turns).where("perspective = 'a'").orderBy("start").collect()
    assert [r.turn for r in shown] == [None, -100, 0, 200]
    ends = [r.start + r.length for r in shown]
    assert [r.start for r in shown] == [0, *ends[:-1]]
