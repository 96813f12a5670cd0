"""Quality classifier from weak labels.

Several heuristic labellers vote on every document (junk, good, or no opinion). Their votes are counted by pattern over
all documents, at most 3^k counts, and expectation-maximisation on these counts, with a class for good and one for each
labeller's kind of junk, estimates how accurate each labeller is and how likely each pattern is junk. The posteriors are the labels of a linear scorer on hashed pairs of bytes, which is
fitted on a sample of bounded size and then scores every document; it also decides where labellers abstain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the scorer is fitted on, about; hashed features; documents scoring below the threshold are junk.
SAMPLE = 2_000
FEATURES = 1_024
THRESHOLD = 0.5
EM_ROUNDS = 100
PRIOR_FEATURES = 50
FIT_ROUNDS = 500
JUNK, NONE, GOOD = 0, 1, 2

_UPPER, _LOWER, _DIGIT = (np.arange(*r) for r in ((65, 91), (97, 123), (48, 58)))
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)


def _votes(data: np.ndarray) -> list[int]:
    """Votes of the labellers `LABELLERS` on the UTF-8 bytes of a text."""
    n = len(data)
    if not n:
        return [JUNK] * len(LABELLERS)
    counts = np.bincount(data, minlength=256)
    upper, digits, spaces = int(counts[_UPPER].sum()), int(counts[_DIGIT].sum()), int(counts[_SPACE].sum())
    letters = upper + int(counts[_LOWER].sum()) + int(counts[128:].sum())
    words = len(data.tobytes().split())
    lines = data.tobytes().split(b"\n")
    visible = max(1, n - spaces)

    def above(value: float, good: float, junk: float) -> int:
        return JUNK if value > junk else GOOD if value <= good else NONE

    return [
        above(int(counts[_SYMBOLS].sum()) / visible, 0.02, 0.08),
        above(upper / max(1, letters), 0.12, 0.3),
        above(int(counts[124]) / max(1, words), 0.01, 0.15),
        above(int(counts[33]) / max(1, words), 0.02, 0.2),
        above(digits / visible, 0.05, 0.2),
        above(visible / max(1, words), 11, 18),
        JUNK if letters < 0.6 * visible else GOOD if letters > 0.85 * visible else NONE,
        JUNK if len(lines) >= 4 and len(set(lines)) < 0.5 * len(lines) else NONE,
        above(_repeats(data) / max(1, words), 0.05, 0.3),
    ]


LABELLERS = ("symbols", "capitals", "bars", "exclamations", "digits", "long_words", "letters", "repeated_lines", "repeated_words")


def _repeats(data: np.ndarray) -> int:
    """How many words are the word before them once more."""
    words = data.tobytes().split()
    return sum(map(eq, words, words[1:]))


def _features(data: np.ndarray) -> np.ndarray:
    """Hashed features: one for each pair of neighbouring bytes (letters told apart by case only) and repeated word."""
    kind = CLASSES[data].astype(np.uint32)
    kind = np.concatenate([[32], kind, [32]])
    pairs = ((kind[:-1] * 256 + kind[1:]) * np.uint32(2654435761) >> np.uint32(20)).astype(np.intp) % FEATURES
    return np.concatenate([pairs, np.full(_repeats(data), FEATURES - 1, np.intp)])


CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[_UPPER], CLASSES[_LOWER], CLASSES[_DIGIT], CLASSES[128:] = ord("A"), ord("a"), ord("0"), ord("a")


def _bytes_of(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer((value.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def votes(docs: DataFrame, text: str = "text", into: str = "votes") -> DataFrame:
    """All columns but the text, and the votes as one number in base 3."""
    kept = [c for c in docs.columns if c != text]
    picked = docs.select(*kept, docs[text].alias("__text"))
    schema = picked.drop("__text").schema.add(into, "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [reduce(lambda code, vote: 3 * code + vote, _votes(data), 0) for data in _bytes_of(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(codes, pa.int32())], names=schema.names)

    return picked.mapInArrow(run, schema)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of "good" for each vote pattern, each labeller's vote probabilities by class, its accuracy.

    `patterns` has a row of votes per pattern, `counts` how many documents vote so. The classes are good, and a kind of
    junk for each labeller, which starts with the documents that this labeller votes against: junk is of several kinds,
    most labellers know one, and within its kind the calm of the others says nothing. With a single class of junk they
    would outvote the one that knows. A document that two labellers vote against may be of either kind.
    """
    against, n_good = patterns == JUNK, (patterns == GOOD).sum(1)
    n_junk, kinds = against.sum(1), patterns.shape[1]
    # Where nobody speaks, good and junk are even.
    calm = np.where(n_good > 0, 1.0, 0.5)
    start = np.where(n_junk > 0, 0.0, calm)
    shares = np.vstack([start, np.where(n_junk > 0, against.T / np.maximum(1, n_junk), (1 - calm) / kinds)])
    one_hot = np.stack([patterns == v for v in (JUNK, NONE, GOOD)], 2).astype(float)
    # One vote of smoothing: on a kind that is not its own, a labeller votes as it does on all documents. That it is not
    # against good documents is believed as firmly as the corpus is large: patterns of one junk vote fit the good class
    # as well as their kind, and would drift.
    usual = (np.einsum("p,plv->lv", counts, one_hot) + 1) / (counts.sum() + 3)
    belief = np.repeat(usual[None], 1 + kinds, 0)
    belief[0] += counts.sum() * usual * [0.0, 1.0, 1.0]
    belief[np.arange(1, 1 + kinds), np.arange(kinds)] = [2.0, 1.0, 0.1]
    for _ in range(rounds):
        weight = shares * counts
        prior = (weight.sum(1) + 1) / (weight.sum() + 1 + kinds)
        table = np.einsum("cp,plv->clv", weight, one_hot) + belief
        table /= table.sum(2, keepdims=True)
        chance = np.log(prior)[:, None] + np.einsum("plv,clv->cp", one_hot, np.log(table))
        shares = np.exp(chance - chance.max(0))
        shares /= shares.sum(0)
    junk = prior[1:]
    right = prior[0] * table[0, :, GOOD] + np.einsum("c,cl->l", junk, table[1:, :, JUNK])
    wrong = prior[0] * table[0, :, JUNK] + np.einsum("c,cl->l", junk, table[1:, :, GOOD])
    return shares[0], table, right / (right + wrong)


class Scorer:
    """Weights of the hashed features; a document's score is the logistic of their mean over its features.

    A short text says little about its weights: `PRIOR_FEATURES` features of a usual good document are added to each.
    """

    def __init__(self, weights: np.ndarray, bias: float, usual: float = 0.0) -> None:
        self.weights, self.bias, self.usual = weights, bias, usual

    def __call__(self, data: np.ndarray) -> float:
        own = self.weights[_features(data)]
        margin = (own.sum() + PRIOR_FEATURES * self.usual) / (len(own) + PRIOR_FEATURES) + self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def fit_scorer(shares: np.ndarray, posterior: np.ndarray, rounds: int = FIT_ROUNDS) -> Scorer:
    """Logistic regression on shares of features with soft labels; both classes weigh the same."""
    if not len(shares):
        return Scorer(np.zeros(FEATURES), 0.0)
    mean, spread = shares.mean(0), shares.std(0) + 1e-4
    x = ((shares - mean) / spread).astype(np.float32)
    weight = np.where(posterior > 0.5, 0.5 / max(1e-9, posterior.sum()), 0.5 / max(1e-9, (1 - posterior).sum()))
    w, b, rate = np.zeros(x.shape[1]), 0.0, 0.5 / np.sqrt(x.shape[1])
    for _ in range(rounds):
        gap = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - posterior)
        w -= rate * (x.T @ gap + 1e-3 * w)
        b -= rate * gap.sum()
    weights = w / spread
    usual = float((shares @ weights * posterior).sum() / max(1e-9, posterior.sum()))
    return Scorer(weights, b - float((w * mean / spread).sum()), usual)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[Scorer, np.ndarray]:
    """The scorer, and the posterior of "good" by vote code (all documents are counted; `sample` bounds the fit)."""
    counted = votes(docs.select(text), text).groupBy("votes").count().collect()  # at most 3^k patterns
    codes = np.array([r["votes"] for r in counted], np.int64)
    by_code = np.full(3 ** len(LABELLERS), 0.5)
    if not len(codes):
        return fit_scorer(np.zeros((0, FEATURES)), np.zeros(0)), by_code
    patterns = np.stack([codes // 3**i % 3 for i in reversed(range(len(LABELLERS)))], 1)
    counts = np.array([r["count"] for r in counted], float)
    by_code[codes], _, _ = estimate(patterns, counts)

    # A sample by hash: the same rows on every run. Rare patterns of junk are kept at a higher rate.
    n, n_junk = counts.sum(), counts[by_code[codes] < 0.5].sum()
    rates = np.where(by_code < 0.5, min(1.0, sample / 2 / max(1, n_junk)), min(1.0, sample / 2 / max(1, n - n_junk)))
    picked = docs.select((F.pmod(F.xxhash64(key, text), F.lit(1 << 30)) / (1 << 30)).alias("at"), F.col(text).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for at, data in zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1))):
                if at >= max_rate:
                    continue
                code = reduce(lambda c, vote: 3 * c + vote, _votes(data), 0)
                if at < rates[code]:
                    found = np.bincount(_features(data), minlength=FEATURES)
                    rows.append((found / found.sum()).astype(np.float32).tobytes())
                    labels.append(by_code[code])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(rows, pa.binary())], names=["label", "shares"])

    max_rate = float(rates.max())
    taken = picked.where(F.col("at") < max_rate).mapInArrow(features, "label double, shares binary").toPandas()
    shares = np.frombuffer(b"".join(taken["shares"]), np.float32).reshape(len(taken), FEATURES)
    return fit_scorer(shares, taken["label"].to_numpy()), by_code


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] | None = None) -> DataFrame:
    """`keep` columns (the key, if not given), score (0 to 1) and good (score reaches the threshold) of every row.

    Null and empty texts score 0. Repeated rows get the same score.
    """
    scorer, _ = learn(docs, key, text)
    kept = list(keep) if keep is not None else [key]
    picked = docs.select(*kept, docs[text].alias("__text"))
    schema = picked.drop("__text").schema.add("score", "double").add("good", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([scorer(data) if len(data) else 0.0 for data in _bytes_of(batch.column(len(kept)))], float)
            columns = [*batch.columns[: len(kept)], pa.array(scores), pa.array(scores >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return picked.mapInArrow(run, schema)


def good_only(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text is good by the classifier that is learned from all of them.

    Null and empty texts are not good. Rows with the same text stay or go together; of an empty table nothing stays.
    """
    scorer, _ = learn(docs, key, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([len(data) > 0 and scorer(data) >= threshold for data in _bytes_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
