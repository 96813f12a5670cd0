"""Neighbouring words, forms and roots against comparisons of all pairs, and odd rows."""

import random
import re
import zlib
from collections import Counter

from rankintel.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def apart_by_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=10):
    near = {w: [v for v in counts if apart_by_one(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= times * counts[word]:
            form[word] = best
    out = set()
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        out.add((word, form.get(word), root, n, len(near[word]), counts[form[word]] if word in form else None))
    return out


def counted(rows, edit=True):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_Z)
            h = zlib.crc32(f"{key}:{run}".encode())
            if edit and key is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def some_words(rng, n=220):
    """Words with many neighbours, shared prefixes, repeated letters, and counts that differ by powers of ten."""
    words = ["".join(rng.choices("abé", k=rng.randint(7, 11))) for _ in range(n)]
    words += ["a" * k for k in range(7, 16)] + ["b" * 6 + c * k for c in "acÿ" for k in (1, 2)] + ["x" * 80, "x" * 79 + "y", "x" * 81, "abcdefg", "bcdefgh"]
    for word in words[:40]:
        at = rng.randrange(len(word))
        words += [word[:at] + word[at + 1 :] + "z", word[:at] + "q" + word[at + 1 :], word[:at] + "q" + word[at:], "q" + word, word + "q"]
    return {w: rng.choice([2, 3, 20, 30, 200, 2000, 30_000]) for w in words if len(w) >= 7}


def test_variants_match_all_pairs(spark):
    counts = some_words(random.Random(7))
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()]
    assert len(got) == len(counts)
    assert set(got) == brute(counts)
    assert any(r[1] is not None and r[1] != r[2] for r in got)  # a chain of forms


def test_groups_of_texts(spark):
    rng = random.Random(8)
    words = [w for w, n in some_words(rng, 60).items() for _ in range(1 + n // 1000)]
    rows = [(i, rng.choice([" ", ", ", "\n", "1"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.choices(words, k=90))) for i in range(60)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (900, None), (901, ""), (None, rows[5][1]), (902, "×÷" * 5 + " " + "Āabcdefg" * 2), (903, "word " * 3000 + "Wordlike wordlika " * 2000)]
    docs = spark.createDataFrame([(k, t, "other", 1) for k, t in rows], SCHEMA)
    got = [tuple(r) for r in spelling.spelling_groups(docs, edit=spelling.letter_dropped).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(counted(rows))
    plain = {(r.word, r.n) for r in spelling.spelling_groups(docs).collect()}
    assert plain == set(counted(rows, edit=False).items())
    assert spelling.spelling_groups(docs.limit(0)).count() == 0


def test_a_node_that_a_third_of_all_words_pass(spark):
    """Words with one long prefix in common: nothing is paired that is not near."""
    counts = {f"sharedprefix{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")): 2 for i in range(0, 30_000, 37)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == brute(counts)


def test_one_word_and_none(spark):
    one = spark.createDataFrame([("onlyword", 5)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(one).collect()] == [("onlyword", None, "onlyword", 5, 0, None)]
    assert spelling.variants(one.limit(0)).count() == 0
