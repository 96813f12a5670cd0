"""Spelling variants: words one edit apart, found by walking a trie that is a table.

The trie's edge table has a row per node: its parent, the letter that leads to it, and what can be said of the words
below (how many, which lengths and which letters come next, and of at most two words how they end). A state is a word,
a place in it, a node and one edit. States begin where the node of a word's own prefix has an edge of another letter:
taken in place of the word's next letter or before it. Level by level, states are joined with the edge table along
their next letter; a state dies where no such edge is or nothing below it fits what is left, and becomes a pair of
neighbours where it ends at a word.

Two words one edit apart have their first or their second half in common. Edits are therefore tried only in the second
half, in a trie of the words and in one of the reversed words, where few words share a node. All levels of both tries
are walked at once, and letters in which all words below a node agree count as one, so the number of joins is that of the branchings
a state still passes in company.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankintel.llm.shared import stored

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form has at least so many times the word's occurrences.
FORM_TIMES = 10
#: Distinct words that a task counts before it passes the counts on.
COUNTED_AT_ONCE = 200_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

Edit = Callable[[int | None, list[str]], list[str]]


def letter_dropped(key: int | None, runs: list[str]) -> list[str]:
    """Runs of a text as the query changes them: one of 31 loses a letter, by a checksum of key and run."""
    if key is None:
        return runs
    start, out = zlib.crc32(f"{key}:".encode()), []
    for run in runs:
        h = zlib.crc32(run.encode(), start)
        at = h % len(run)
        out.append(run if h % 31 else run[:at] + run[at + 1 :])
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Edit | None = None, letters: int = LEAST_LETTERS) -> DataFrame:
    """word, n: the runs of letters (A-Z, a-z, U+00C0 to U+00FF) of at least `letters`, in lower case, in whole texts.

    A null text has none. `edit` changes the distinct runs of a text (see `letter_dropped`).
    """
    find = re.compile(f"[a-zÀ-ÿ]{{{letters},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for key_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Counter(find((value.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")))
                words = list(own)
                for word, n in zip(edit(key_, words) if edit else words, own.values()):
                    if len(word) >= letters:
                        counts[word] += n
                if len(counts) >= COUNTED_AT_ONCE:
                    yield passed()
        yield passed()

    return docs.select(key, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _node(prefix: Column) -> Column:
    """A node's number: a hash of its trie (of words or of reversed words) and of its letters."""
    return F.xxhash64("trie", prefix)


def _spelled(words: DataFrame) -> DataFrame:
    """trie, s: each word, and each word from its end."""
    return words.select(F.explode(F.array(F.struct(F.lit(0).alias("trie"), F.col("word").alias("s")), F.struct(F.lit(1).alias("trie"), F.reverse("word").alias("s")))).alias("w")).select("w.*")


def _from(text: str, at: Column) -> Column:
    return F.substring(F.col(text), at, F.length(text))


def _edges(spelled: DataFrame) -> DataFrame:
    """node, parent, letter and, of the words below, n, lengths and letters that follow (as bits), least and last tail,
    and in how many letters all tails agree: those of the least and the last.

    Only depths of the second half are kept: no state that looks for a shorter part of a word goes by there.
    """
    depth = F.explode(F.sequence(F.floor((F.length("s") - 1) / 2).cast("int") + 1, F.length("s"))).alias("d")
    d = F.col("d")
    rows = spelled.select("trie", "s", depth).select(
        _node(F.substring("s", F.lit(1), d)).alias("node"),
        _node(F.substring("s", F.lit(1), d - 1)).alias("parent"),
        F.substring("s", d, F.lit(1)).alias("letter"),
        _from("s", d + 1).alias("tail"),
    )
    length, follow = _bit(F.least(F.length("tail"), F.lit(63))), F.when(F.col("tail") != "", _bit(F.ascii("tail") % 64)).otherwise(F.lit(0))
    of = [F.count("*").alias("n"), F.bit_or(length).alias("lengths"), F.bit_or(follow).alias("follow"), F.min("tail").alias("least"), F.max("tail").alias("last")]
    most = F.least(F.length("least"), F.length("last"))
    alike = F.filter(F.sequence(F.lit(1), most), lambda i: F.substring("least", F.lit(1), i) == F.substring("last", F.lit(1), i))
    common = F.when((F.col("n") > 2) & (most > 0), F.size(alike)).otherwise(0)
    return rows.groupBy("node", "parent", "letter").agg(*of).withColumn("common", common)


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int"))


def _steps(states: DataFrame) -> DataFrame:
    """States that what is below their node (columns of `_edges`) may still fit: trie, s, v, at, found.

    `v` is the word that a state would end at, `at` how many of its letters have been followed.
    """
    rest = _from("v", F.col("at") + 1)
    fits = (F.getbit("lengths", F.least(F.length(rest), F.lit(63))) == 1) & ((rest == "") | (F.getbit("follow", F.ascii(rest) % 64) == 1))
    # Of at most two words below the ends are known; of more, letters in which all agree are followed at once.
    common = F.col("common")
    fits &= F.when(F.col("n") > 2, F.substring(rest, F.lit(1), common) == F.substring("least", F.lit(1), common)).otherwise((rest == F.col("least")) | (rest == F.col("last")))
    return states.where(fits).select("trie", "s", "v", (F.col("at") + common).alias("at"), ((F.col("n") <= 2) | (F.length(rest) == common)).alias("found"))


def _begun(spelled: DataFrame, edges: DataFrame) -> DataFrame:
    """States after their edit: at each node of the second half of a word, along edges of other letters.

    Of two words of one length only the smaller looks for the larger, and of two lengths the shorter for the longer.
    """
    depth = F.explode(F.sequence(F.floor(F.length("s") / 2).cast("int"), F.length("s"))).alias("d")
    d = F.col("d")
    own = spelled.select("trie", "s", depth).select("trie", "s", "d", _node(F.substring("s", F.lit(1), d)).alias("parent"), F.substring("s", d + 1, F.lit(1)).alias("own"))
    met = own.join(edges, "parent").where("letter <> own")
    before = F.concat(F.substring("s", F.lit(1), d), "letter")
    replaced = F.when((F.col("own") != "") & (F.col("letter") > F.col("own")), F.concat(before, _from("s", d + 2)))
    inserted = F.concat(before, _from("s", d + 1))
    made = met.select("*", F.explode(F.array_compact(F.array(replaced, inserted))).alias("v"), (d + 1).alias("at"))
    return _steps(made)


def neighbours(words: DataFrame) -> DataFrame:
    """a, b: all pairs of `words` (distinct, not null, column `word`) one inserted, deleted or replaced letter apart, both ways round.

    `words` should be a stored table. The empty word has no node and no neighbours.
    """
    spelled = _spelled(words)
    edges = stored(_edges(spelled), "edges")
    level = stored(_begun(spelled, edges), "states")
    found = [level.where("found")]
    below = edges.drop("parent", "letter")
    while not level.where("NOT found").isEmpty():
        next_ = level.where("NOT found").select("trie", "s", "v", (F.col("at") + 1).alias("at")).withColumn("node", _node(F.substring("v", F.lit(1), F.col("at"))))
        level = stored(_steps(next_.join(below, "node")), "states")
        found.append(level.where("found"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    back = F.col("trie") == 1
    pairs = pairs.select(F.when(back, F.reverse("s")).otherwise(F.col("s")).alias("a"), F.when(back, F.reverse("v")).otherwise(F.col("v")).alias("b")).distinct()
    # A hash stood for each node; that `b` is a word is made sure of here.
    pairs = pairs.join(words.select(F.col("word").alias("b")), "b", "left_semi")
    return pairs.select("a", "b").union(pairs.select("b", "a"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where one gets from each word by following `form` to the last (one row a word, no cycles).

    Each round doubles the steps that are taken, so the rounds are the logarithm of the longest way.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(onward, "root", "left").select("word", "root", "further"), "roots")
        now = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.where("further IS NOT NULL").isEmpty():
            return now


def variants(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of `words` (word, n).

    A word's form is the neighbour of largest n (ties: the smallest word by code points), if that n is at least
    `times` the word's; the root is where forms lead to in the end, the word itself without one.
    """
    words = stored(words.select("word", "n"), "words")
    near = neighbours(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("less"), "b")).alias("best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("b"), (-F.col("best.less")).alias("nb"))
    joined = words.join(best, "word", "left")
    large = F.col("nb") >= times * F.col("n")
    joined = stored(joined.select("word", F.when(large, F.col("b")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(large, F.col("nb")).alias("form_n")), "forms")
    ends = roots(joined.where("form IS NOT NULL"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Edit | None = None, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """`variants` of the words of at least `letters` letters that occur `least` times or more in the texts of `docs`.

    Null and empty texts have no words; repeated rows count as often as they are there; an empty table has no words.
    """
    return variants(word_counts(docs, key, text, edit, letters).where(F.col("n") >= least))
