"""Runs of periodic words against a scan of every lag, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from rankintel.llm import periodic

SCHEMA = "doc_id long, text string, start string, __key string, __text string"


def brute(words, least=12):
    """Every stretch with a period of at least two periods, by its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start >= q:
                found.setdefault((start, i - start + q), q)
    return sorted((s, q, n) for (s, n), q in found.items() if n >= least)


def changed(key, words):
    """The query's edit, word by word."""
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def texts(rng, n):
    out = []
    for i in range(n):
        kinds = rng.choice([1, 2, 2, 3, 6, 60])
        base = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(250))]
        if i % 5 == 0 and base:
            unit = base[: rng.randrange(1, len(base) + 1)]
            base = base[: rng.randrange(len(base))] + unit * rng.randrange(1, 6) + base[-3:]
        if i % 5 == 1:
            a, b = ["a"], ["a", "b"]
            for _ in range(rng.randrange(3, 11)):
                a, b = b, b + a
            base = b
        if i % 5 == 2:
            base = [w for _ in range(rng.randrange(1, 8)) for w in ["a"] * rng.randrange(1, 60) + ["b"]]
        out.append(rng.choice([" ", "\n", " \t"]).join(base))
    return out


def expected(key, text, edit):
    words = edit(key, (text or "").encode().split())
    runs = brute(words)
    dropped = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    longest = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (key, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def rows_of(seed=4):
    rng = random.Random(seed)
    rows = list(enumerate(texts(rng, 90)))
    rows += [(3, "a repeated key"), (1000, None), (1001, ""), (1002, " \n\t"), (None, "x " * 40), (None, None), (1003, "ä " * 12), (1003, "ä " * 12), (1004, "é " * 11)]
    return rows + [(1005, " ".join(f"v{i % 700}" for i in range(2100))), (1006, " ".join(f"v{i}" for i in range(2500)))]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "s", "k", "t") for k, t in rows], SCHEMA)


def test_digest_matches_every_lag(spark, rows):
    given = rows_of()
    for edit, by_hand in ((None, lambda key, words: words), (periodic.planted, changed)):
        got = rows(periodic.digest(frame(spark, given), edit=edit))
        assert got == sorted((expected(k, t, by_hand) for k, t in given), key=lambda t: [(v is not None, str(v)) for v in t])
    assert periodic.digest(frame(spark, [])).count() == 0


def test_runs_and_collapsed_texts(spark):
    given = [(k, t) for k, t in rows_of(5) if k is not None and k != 3 and k != 1003]
    found = {}
    for r in periodic.runs(frame(spark, given)).collect():
        found.setdefault(r[0], []).append((r[1], r[3], r[2]))
    kept = {r.doc_id: r for r in periodic.collapse(frame(spark, given)).collect()}
    assert len(kept) == len(given)
    for key, text in given:
        runs = brute((text or "").split())
        assert sorted(found.get(key, [])) == runs
        dropped = {i for s, q, n in runs for i in range(s + q, s + n)}
        assert kept[key].text == (" ".join(w for i, w in enumerate(text.split()) if i not in dropped) if runs else text)
        assert (kept[key].start, kept[key]["__key"], kept[key]["__text"]) == ("s", "k", "t")


def test_a_long_stretch_of_one_word_forms_no_pairs(monkeypatch):
    """Seeds within one run of a short period are not paired: the pairs do not grow with its length."""
    formed = []
    seeds = periodic._seeds
    monkeypatch.setattr(periodic, "_seeds", lambda *given: (formed.append(len(at)) or (at, lag) for at, lag in seeds(*given)))
    (own,) = periodic._runs_by_text([b" ".join([b"a"] * 100_000)])
    assert [tuple(x.tolist()) for x in own] == [(0,), (100_000,), (1,)]
    assert sum(formed) == 0


@pytest.mark.parametrize("width", [1, 2, 3, 9, 17])
def test_minimizers_are_the_minima_of_all_windows(width):
    hashes = np.random.default_rng(1).integers(0, 40, 300, np.uint64) + np.uint64(1)
    expected = {i for s in range(300 - width + 1) for i in range(s, s + width) if hashes[i] == hashes[s : s + width].min()}
    assert set(periodic.minimizers(hashes, width).tolist()) == expected
