"""Language identification in two steps: the family first, then the language within it.

Families are found from the data: languages whose letter-triple profiles are more alike than languages are on average.
One-versus-one linear support vector machines tell families apart, and others the languages of a family. They are
fitted on a bounded number of labelled texts of each language and applied to every whole text. All features are hashed
triples of letters, so a score is a mean of weights over the triples of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
FEATURES = 4_096
#: Labelled texts of each language that the machines are fitted on, at most.
SAMPLE = 500
#: How many times that number are taken, so that chance leaves enough.
SPARE = 1.5
FIT_ROUNDS = 120
#: Rows that a fit has in double precision at a time.
BLOCK_ROWS = 64

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_has_letter = regex.compile(r"\p{L}").search


def _triples(text: str) -> np.ndarray:
    """Hashed triples of neighbouring letters (bytes in lower case, all else read as a blank)."""
    data = _LETTERS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    mixed = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(20)).astype(np.intp) % FEATURES


def _packed(text: str) -> bytes:
    """The shares of a text's features that are not 0 (32 bits each), then the numbers of these features (16 bits)."""
    found = np.bincount(_triples(text), minlength=FEATURES)
    at = np.flatnonzero(found)
    return (found[at] / found.sum()).astype(np.float32).tobytes() + at.astype(np.uint16).tobytes()


def _unpacked(packed: list[bytes]) -> np.ndarray:
    """A row of shares for each text."""
    shares = np.zeros((len(packed), FEATURES), np.float32)
    for row, own in zip(shares, packed):
        n = len(own) // 6
        row[np.frombuffer(own, np.uint16, n, 4 * n)] = np.frombuffer(own, np.float32, n)
    return shares


def _machine(z: np.ndarray, side: np.ndarray, rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss) on shares of features, which it overwrites; `side` is -1 or 1.

    Rows are taken in small blocks: the driver holds no other copy of them, and none in double precision.
    """
    mean = z.mean(0)
    z -= mean
    spread = np.concatenate([np.sqrt(np.square(z[:, at : at + 256]).sum(0) / np.float32(len(z))) for at in range(0, z.shape[1], 256)]) + np.float32(1e-4)
    z /= spread
    weight = np.where(side > 0, 0.5 / (side > 0).sum(), 0.5 / (side < 0).sum())
    w, b, rate = np.zeros(z.shape[1]), 0.0, 0.5 / np.sqrt(z.shape[1])
    for _ in range(rounds):
        up, up_b = np.zeros_like(w), 0.0
        for at in range(0, len(z), BLOCK_ROWS):
            rows, own = z[at : at + BLOCK_ROWS].astype(np.float64), side[at : at + BLOCK_ROWS]
            slack = np.maximum(0.0, 1.0 - own * (rows @ w + b)) * weight[at : at + BLOCK_ROWS] * own
            up += slack @ rows
            up_b += slack.sum()
        w += rate * (up - 1e-3 * w)
        b += rate * up_b
    return w / spread, b - float((w * mean / spread).sum())


class Model:
    """Families, languages and the machines between them."""

    def __init__(self, shares: np.ndarray, langs: np.ndarray) -> None:
        self.languages = sorted(set(langs))
        self.families = _families({lang: shares[langs == lang].mean(0) for lang in self.languages})
        self.pairs: list[tuple[tuple[str, ...], tuple[str, ...]]] = list(combinations(self.families, 2))
        for family in self.families:
            self.pairs += [((a,), (b,)) for a, b in combinations(family, 2)]
        machines = []
        for left, right in self.pairs:
            a, b = np.isin(langs, left), np.isin(langs, right)
            machines.append(_machine(shares[a | b], np.where(a[a | b], 1.0, -1.0)))
        self.weights = np.stack([w for w, _ in machines], 1).astype(np.float32) if machines else np.zeros((FEATURES, 0), np.float32)
        self.bias = np.array([b for _, b in machines])
        self._at = {pair: i for i, pair in enumerate(self.pairs)}

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how sure it is (0 to 1); `und` and 0 without a letter or without anything learned."""
        if not text or not self.languages or not _has_letter(text):
            return UNDETERMINED, 0.0
        margins = self.weights[_triples(text)].mean(0, dtype=np.float64) + self.bias
        family, sure = self._winner(self.families, margins)
        lang, surer = self._winner([(lang,) for lang in family], margins) if len(family) > 1 else (family, 1.0)
        return lang[0], sure * surer

    def _winner(self, sides: list[tuple[str, ...]], margins: np.ndarray) -> tuple[tuple[str, ...], float]:
        """The side that wins most of its duels (then by margin), and the chance that it wins the closest of them."""
        if len(sides) == 1:
            return sides[0], 1.0
        own = {side: [margins[self._at[side, o]] if (side, o) in self._at else -margins[self._at[o, side]] for o in sides if o != side] for side in sides}
        best = max(sides, key=lambda side: (sum(m > 0 for m in own[side]), sum(own[side])))
        return best, float(1 / (1 + np.exp(-4 * np.clip(min(own[best]), -10, 10))))


def _families(profiles: dict[str, np.ndarray]) -> list[tuple[str, ...]]:
    """Languages all of whose profiles are more alike than the mean of all pairs, the most alike joined first."""
    unit = {lang: np.sqrt(p) / max(1e-12, np.sqrt(p.sum())) for lang, p in profiles.items()}
    likeness = {frozenset(pair): float(unit[pair[0]] @ unit[pair[1]]) for pair in combinations(sorted(unit), 2)}
    families = [(lang,) for lang in sorted(unit)]
    mean = np.mean(list(likeness.values())) if likeness else 1.0
    while len(families) > 1:
        least = {(f, g): min(likeness[frozenset((a, b))] for a in f for b in g) for f, g in combinations(families, 2)}
        (f, g), value = max(least.items(), key=lambda item: item[1])
        if value <= mean:
            break
        families = sorted([*(h for h in families if h not in (f, g)), tuple(sorted(f + g))])
    return families


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` texts of each language, chosen by a hash of key and length.

    Each language is counted first; then the rows whose hash is in a share that holds `SPARE` times the sample are
    taken, all of a rare language. Null and empty texts and rows without a language teach nothing; of an empty table
    the model predicts nothing.
    """
    at = F.pmod(F.xxhash64(docs[key], F.length(docs[text])), F.lit(1 << 30)) / (1 << 30)
    rows = docs.select(docs[lang].alias("lang"), docs[text].alias("text"), at.alias("at")).where("lang IS NOT NULL AND length(text) > 0")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row per language
    if not counts:
        return Model(np.zeros((0, FEATURES)), np.array([], object))
    wanted = F.lit(False)
    for r in counts:
        wanted = wanted | ((F.col("lang") == r["lang"]) & (F.col("at") < SPARE * sample / r["n"]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_packed(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["lang", "packed", "at"])

    taken = rows.where(wanted).select("lang", "text", "at").mapInArrow(features, "lang string, packed binary, at double").toPandas()
    # Of repeated rows, whose hashes are equal, the first are as good as any.
    taken = taken.sort_values(["lang", "at", "packed"]).groupby("lang").head(sample)
    shares = _unpacked(taken.pop("packed").tolist())
    return Model(shares, taken["lang"].to_numpy())


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns, lang_pred and score of every row; null texts and texts without a letter are `und`."""
    picked = docs.select(*keep, docs[text].alias("__text"))
    schema = picked.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(value.as_py()) for value in batch.column(len(keep))]
            columns = [*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return picked.mapInArrow(run, schema)


def determined_only(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose language the model can tell: null texts and texts without a letter go."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.predict(value.as_py())[0] != UNDETERMINED for value in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: a remainder of 2 of the key's checksum."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_held_out(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score of every row; learned from labelled rows that are not held out."""
    model = learn(docs.where(~held_out(F.col(key))), key, text, lang)
    return predict(docs, model, (key,), text).select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
