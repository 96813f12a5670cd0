"""Fingerprints, near duplicates, repeated passages, quality and language against brute force and odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankintel.llm import chat, fingerprint, language, ngram_join, quality, substring, topk, urls
from rankintel.llm.components import components

SCHEMA = "doc_id long, text string, doc string, hash string, lang string, n int"
WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1, n=60):
    """Fresh texts, copies, near copies, a hot line, shared passages, repeated rows, odd rows."""
    rng = random.Random(seed)
    line = " ".join(rng.choices(WORDS, k=20))
    texts = []
    for i in range(n):
        kind = i % 6
        if kind in (0, 1) or i < 6:
            texts.append(" ".join(rng.choices(WORDS, k=rng.randint(1, 120))))
        elif kind == 2:
            texts.append(texts[rng.randrange(i)])
        elif kind == 3:
            words = texts[rng.randrange(i)].split() or ["x"]
            words[rng.randrange(len(words))] = "Changed"
            texts.append("\n".join(words))
        else:
            texts.append(line + " " + " ".join(rng.choices(WORDS, k=60)) + (" the" * 30 if kind == 5 else ""))
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (3, "other text of a repeated key"), (1000, None), (1001, ""), (1002, " \t"), (1003, "One"), (1004, "one"), (None, texts[1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "a", "b", "en", 1) for k, t in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_fingerprints(spark):
    rows = [(k, t) for k, t in corpus() if k is not None][:-7]
    rows = list(dict(rows).items()) + [(5000, None), (5001, "ä" * 300)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows), run_rows=4).collect()}
    order = sorted(rows)
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own, other, after = (fingerprint.chunks_of(t.encode()) for t in (text, changed, following))
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.written(own), fingerprint.written(other))
        assert (r.near_edited, r.near_next) == (fingerprint.containment(own, other), fingerprint.containment(own, after))
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0
    assert fingerprint.fingerprints(frame(spark, corpus())).count() == len(corpus())


def test_chunks_resist_shifts():
    rng = random.Random(2)
    text = " ".join(rng.choices(WORDS, k=2000)).encode()
    own, shifted = fingerprint.chunks_of(text), fingerprint.chunks_of(b"inserted words " + text)
    assert fingerprint.containment(own, shifted) > 0.95
    assert fingerprint.containment(own, fingerprint.chunks_of(" ".join(rng.choices(WORDS, k=2000)).encode())) < 0.2


def brute_components(rows):
    def shingles(text):
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
        return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()

    keyed = [(k, shingles(t)) for k, t in rows if k is not None]
    head = {k: k for k, _ in keyed}
    changed = True
    while changed:
        changed = False
        for a, s in keyed:
            for b, t in keyed:
                if s and t and 100 * len(s & t) >= 85 * len(s | t) and head[a] != head[b]:
                    head[a] = head[b] = min(head[a], head[b])
                    changed = True
    return {k: head[k] for k in head}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicate_components(spark, seed):
    rows = corpus(seed)
    got = ngram_join.components_of(frame(spark, rows)).collect()
    expected = brute_components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_near_copies_that_only_the_original_links(spark):
    words = [f"q{i}" for i in range(140)]
    rows = [(500, " ".join(words))]
    for i in range(60):
        own = list(words)
        own[2 * i] = own[(2 * i + 70) % 140] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in ngram_join.components_of(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_cut(rows):
    first = {}
    top = 1 << 62
    for k, t in rows:
        w = words_of(t)
        for i in range(len(w) - 12):
            gram = tuple(w[i : i + 13])
            first[gram] = min(first.get(gram, top), top if k is None else k)
    out = []
    for k, t in rows:
        w = words_of(t)
        gone = {j for i in range(len(w) - 12) if (top if k is None else k) > first[tuple(w[i : i + 13])] for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_passages(spark, seed, monkeypatch):
    rows = corpus(seed)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_cut(rows)
    cut = substring.cut(frame(spark, rows))
    assert cut.columns == frame(spark, rows).columns
    kept = sorted((r.doc_id, hashlib.sha256(" ".join(words_of(r.text)).encode()).hexdigest()) for r in cut.where("doc_id IS NOT NULL").collect())
    assert kept == sorted((k, d) for k, _, _, d in brute_cut(rows) if k is not None)
    assert substring.dedup(frame(spark, [])).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["the", "of", "night", "river", "stone", "walks"], k=rng.randint(20, 90))).capitalize() + "." for _ in range(300)]
    junk = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in t.split()) for t in good[:40]] + [t.upper().replace(" ", "!! ") for t in good[40:70]]
    rows = list(enumerate(good + junk)) + [(9000, None), (9001, "")]
    got = {r.doc_id: r.good for r in quality.classify(frame(spark, rows)).collect()}
    assert sum(got[i] for i in range(300)) >= 297
    assert sum(got[i] for i in range(300, 370)) <= 3
    assert not got[9000] and not got[9001]
    assert quality.classify(frame(spark, [])).count() == 0


def em_by_document(votes, rounds):
    """Posterior of "good" of each document, by loops over documents, classes and labellers; votes 0, 1, 2."""
    n, k = len(votes), len(votes[0])
    usual = [[(sum(v[j] == x for v in votes) + 1) / (n + 3) for x in range(3)] for j in range(k)]
    shares = []
    for v in votes:
        against = [j for j in range(k) if v[j] == quality.JUNK]
        if against:
            shares.append([0.0] + [1 / len(against) if j in against else 0.0 for j in range(k)])
        else:
            calm = 1.0 if quality.GOOD in v else 0.5
            shares.append([calm] + [(1 - calm) / k] * k)
    for _ in range(rounds):
        prior = [(sum(s[c] for s in shares) + 1) / (n + 1 + k) for c in range(1 + k)]
        table = {}
        for c in range(1 + k):
            for j in range(k):
                row = [usual[j][x] for x in range(3)]
                if c == 0:
                    row = [row[x] + (n * usual[j][x] if x != quality.JUNK else 0) for x in range(3)]
                elif c == j + 1:
                    row = [2.0, 1.0, 0.1]
                for v, s in zip(votes, shares):
                    row[v[j]] += s[c]
                for x in range(3):
                    table[c, j, x] = row[x] / sum(row)
        shares = []
        for v in votes:
            chance = [prior[c] * math.prod(table[c, j, v[j]] for j in range(k)) for c in range(1 + k)]
            shares.append([x / sum(chance) for x in chance])
    return [s[0] for s in shares]


def test_estimate_against_loops_over_documents():
    rng = random.Random(3)
    votes = [tuple(rng.choices([0, 1, 2], [1, 2, 8])[0] for _ in range(4)) for _ in range(150)] + [(1, 1, 1, 1), (0, 0, 0, 0)]
    patterns = sorted(set(votes))
    counts = np.array([votes.count(p) for p in patterns], float)
    posterior, table, accuracy = quality.estimate(np.array(patterns), counts, 25)
    by_pattern = dict(zip(patterns, posterior))
    assert np.allclose([by_pattern[v] for v in votes], em_by_document(votes, 25), atol=1e-9)
    assert np.allclose(table.sum(2), 1) and ((0 <= accuracy) & (accuracy <= 1)).all()


def test_a_lone_labeller_is_not_outvoted():
    # Nine in ten are plain; of the junk, each kind is known to one labeller and looks good to the others.
    patterns = np.array([[2] * 5] + [[0 if i == j else 2 for j in range(5)] for i in range(5)])
    for size in (1, 100, 1_000_000):
        posterior, _, accuracy = quality.estimate(patterns, np.array([900, 20, 20, 20, 20, 20]) * size)
        assert posterior[0] > 0.9 and (posterior[1:] < 0.1).all() and (accuracy > 0.8).all()


def test_scorer_against_a_plain_mean():
    rng = np.random.default_rng(5)
    scorer = quality.Scorer(rng.normal(size=quality.FEATURES), -0.3, 0.2)
    for text in ("the the night", "A1 ###", "x", "ä ö ü ä"):
        seen = [32, *[97 if chr(b).islower() or b > 127 else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else b for b in text.encode()], 32]
        places = [(((a * 256 + b) * 2654435761) % 2**32 >> 20) % quality.FEATURES for a, b in zip(seen, seen[1:])]
        words = text.split()
        places += [quality.FEATURES - 1] * sum(a == b for a, b in zip(words, words[1:]))
        total = sum(scorer.weights[p] for p in places) + quality.PRIOR_FEATURES * 0.2
        expected = 1 / (1 + math.exp(-(total / (len(places) + quality.PRIOR_FEATURES) - 0.3)))
        assert math.isclose(scorer(np.frombuffer(text.encode(), np.uint8)), expected, rel_tol=1e-9)


def chunks_byte_by_byte(data):
    """Lengths of chunks, the gear hash of the last 64 bytes summed anew at each byte."""
    ends, start = [], 0
    while start < len(data):
        for end in range(start + 1, len(data) + 1):
            size = end - start
            known = data[max(0, end - 64) : end]
            rolled = sum(int(fingerprint.GEAR[b]) << i for i, b in enumerate(reversed(known))) % 2**64
            bits = 8 if size < 64 else 4  # from the wanted length on, fewer are asked for
            if end == len(data) or size == 256 or (size >= 24 and rolled >> (64 - bits) == 0):
                break
        ends.append(end)
        start = end
    return ends


def test_chunk_boundaries_byte_by_byte():
    rng = random.Random(12)
    texts = [b"", b"x", b"y" * 23, b"z" * 700, " ".join(rng.choices(WORDS, k=500)).encode(), "äöü ß".encode() * 90]
    texts += [bytes(rng.choices(range(256), k=n)) for n in (24, 25, 64, 65, 256, 257, 1500)]
    for data in texts:
        ends = chunks_byte_by_byte(data)
        assert fingerprint.chunk_ends(data) == ends
        sizes, start = {}, 0
        for end in ends:
            sizes[hashlib.blake2b(data[start:end], digest_size=8).hexdigest()] = end - start
            start = end
        assert fingerprint.written(fingerprint.chunks_of(data)) == "".join(f"{d}{n:03x}" for d, n in sorted(sizes.items()))


def test_language(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "ing", "tion"], "de": ["sch", "und", "keit"], "fr": ["eau", "oui", "ent"], "es": ["que", "ado", "cion"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(30)), "a", "b", lang, 1) for i, lang in enumerate(list(parts) * 60)]
    rows += [(5000, None, "a", "b", "en", 1), (5001, "12 34", "a", "b", None, 1), (5002, "thething", "a", "b", None, 1)]
    got = {r.doc_id: r for r in language.predict_held_out(spark.createDataFrame(rows, SCHEMA)).collect()}
    tested = [r for r in rows[:240] if got[r[0]].held_out]
    assert tested and sum(got[r[0]].lang_pred == r[4] for r in tested) >= 0.95 * len(tested)
    assert [(got[k].lang_pred, got[k].score) for k in (5000, 5001)] == [("und", 0.0)] * 2 and got[5002].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict_held_out(spark.createDataFrame([], SCHEMA)).count() == 0


def test_top_k_ties_and_odd_vectors(spark):
    vectors = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (40, [])]
    df = spark.createDataFrame([(k, v, 0, "x") for k, v in vectors], "vec_id long, embedding array<double>, shard int, tile string")
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, k=2).collect())
    assert got == [(0, 1, 2, 2048), (0, 2, 3, 2048), (20, 1, 0, 2048), (20, 2, 2, 2048)]
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_url_rules(spark):
    pages = [(1, "HTTP://A.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://notexample.org"), (4, None), (5, "nothing"), (6, "x://b.com/fr/1"), (6, "x://b.com/fr/1"), (7, "x://com/de")]
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = sorted(tuple(r) for r in urls.judge(spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, host string"), rules).collect())
    assert got == sorted([(1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "notexample.org", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "b.com", "/fr/1", "com/fr/", "allow"), (6, "b.com", "/fr/1", "com/fr/", "allow"), (7, "com", "/de", None, "allow")], key=lambda r: r[0])
    assert urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules.limit(0)).where("verdict = 'allow'").count() == len(pages)


def test_chat_perspectives(spark):
    turns = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi <|end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, None, "?"), (2, 0, "system", "alone"), (None, 0, "ann", "lost")]
    df = chat.rotate(spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, start int"))
    got = df.collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob")} and len(got) == 8
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        text = whole.get(r.perspective, "")
        assert r.start == len(text) and r.length == len(r.segment)
        whole[r.perspective] = text + r.segment
        if r.chat_role == "assistant":
            assert r.speaker == r.perspective
            assert (text + r.segment)[r.mask_start : r.mask_start + r.mask_length].endswith("<|end|>")
        else:
            assert r.mask_length == 0
    assert whole["ann"] == "<|turn|>system<|text|>Be kind<|end|><|turn|>assistant<|text|>Hi < |end|><|end|><|turn|>user bob<|text|><|end|><|turn|>user<|text|>?<|end|>"


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = corpus_pipeline.stored(stage(spark, rows, ""), "stage")
        if name != "best-fit packing":
            assert rows.columns == docs.columns and rows.count() <= before.count()
        if name == "n-gram Jaccard join":
            expected = {k for k, c in brute_components([(r.doc_id, r.text) for r in before.collect()]).items() if k == c}
            assert {r.doc_id for r in rows.collect()} == expected
        if name == "substring dedup":
            expected = brute_cut([(r.doc_id, r.text) for r in before.collect()])
            got = [(r.doc_id, hashlib.sha256(" ".join(words_of(r.text)).encode()).hexdigest()) for r in rows.collect()]
            assert sorted(got) == sorted((k, d) for k, _, _, d in expected)
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
