"""Runs of periodic words in texts, found by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least two periods long, that neither neighbour extends. Periods
come in scales [P, 2P). In a scale, hashes of k consecutive words are compared in windows of w of them, with
w + k - 1 = P: both copies of such a window lie in a run of any of these periods, so their minima are at the same place
and a period apart. Pairs of equal minima at a distance of the scale are seeds, which extend to both sides as far as the
words agree. Periods below the first scale are too short for windows; direct scans at each such lag find their runs.

A seed within one run of a much shorter period says only that this run repeats itself; such pairs are not formed, so
that a long stretch of one word costs no more than others. Texts are handled many at a time, joined by symbols that
occur once and end every agreement. No row meets another one: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from rankintel.llm.words import Windows, mixed

#: Words of a run at least, and the first scale; shorter periods are scanned for directly.
LEAST_WORDS = 12
FIRST_SCALE = 16
#: Words handled at a time (a longer text is alone), and seeds extended at a time.
BLOCK_WORDS = 300_000
SEEDS_AT_ONCE = 500_000

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, length, period


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]), dtype=np.uint64)


class _Sequence:
    """Symbols with hashes of any stretch of them."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols, self.n = symbols, len(symbols)
        self._down = _powers(_INVERSE, self.n + 1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * _powers(_ODD, self.n), dtype=np.uint64)])

    def hashes(self, k: int) -> np.ndarray:
        return mixed((self._sums[k:] - self._sums[:-k]) * self._down[: self.n - k + 1])

    def _same(self, at: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        one = (self._sums[at + size] - self._sums[at]) * self._down[at]
        return one == (self._sums[at + lag + size] - self._sums[at + lag]) * self._down[at + lag]

    def extended(self, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where and to where the symbols around `at` equal those `lag` further."""
        low, high = np.zeros_like(at), self.n - at - lag
        while (low < high).any():
            size = (low + high + 1) // 2
            same = self._same(at, lag, size)
            low, high = np.where(same, size, low), np.where(same, high, size - 1)
        end = at + low
        low, high = np.zeros_like(at), at.copy()
        while (low < high).any():
            size = (low + high + 1) // 2
            same = self._same(at - size, lag, size)
            low, high = np.where(same, size, low), np.where(same, high, size - 1)
        return at - low, end


def _sliding(values: np.ndarray, width: int, least: Callable) -> np.ndarray:
    """Minimum or maximum of each `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        values = least(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return least(values[: len(values) - rest], values[rest:]) if rest else values


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hashes of all windows of `width` hashes (of equal ones, all)."""
    lowest = _sliding(hashes, width, np.minimum)
    around = np.concatenate([np.zeros(width - 1, np.uint64), lowest, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(_sliding(around, width, np.maximum) == hashes)


def _scanned(symbols: np.ndarray, lag: int) -> Runs:
    """Stretches of at least two periods at one lag."""
    at = np.flatnonzero(symbols[lag:] == symbols[:-lag])
    if len(at) < lag:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    breaks = np.flatnonzero(np.diff(at) != 1)
    starts, ends = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + 1
    long = ends - starts >= lag
    starts, ends = starts[long], ends[long]
    return starts, ends - starts + lag, np.full(len(starts), lag)


def _joined(parts: list[Runs]) -> Runs:
    """All runs in order, each once with its smallest period."""
    start, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    # A stretch whose period is a multiple of another's is the same stretch.
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[first], length[first], period[first]


def _seeds(sequence: _Sequence, scale: int, known: Runs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place, lag) of equal minimizers whose distance is of the scale, but for those within one known run."""
    k = scale // 2
    hashes = sequence.hashes(k)
    places = minimizers(hashes, scale - k + 1)
    order = np.argsort(hashes[places], kind="stable")
    places = places[order]
    found = hashes[places]
    group = np.concatenate([[0], np.cumsum(found[1:] != found[:-1])])
    stride = sequence.n + 2 * scale
    key = group * stride + places
    first, last = np.searchsorted(key, key + scale), np.searchsorted(key, key + 2 * scale)
    # The run of a period of at most k / 2 that holds all k words of a seed, if there is one, is the only one.
    start, length, period = (x[(known[2] <= k // 2) & (known[1] >= k)] for x in known)
    if len(start):
        own = np.searchsorted(start, places, side="right") - 1
        until = (start + length - k)[np.maximum(own, 0)]
        inside = (own >= 0) & (places <= until)
        first = np.where(inside, np.maximum(first, np.searchsorted(key, group * stride + until, side="right")), first)
    counts = np.maximum(0, last - first)
    some = np.flatnonzero(counts)
    total = np.cumsum(counts[some])
    for part in np.split(some, np.flatnonzero(np.diff(total // SEEDS_AT_ONCE)) + 1) if len(some) else []:
        left = np.repeat(part, counts[part])
        step = np.arange(len(left)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
        yield places[left], places[first[left] + step] - places[left]


def _confirmed(symbols: np.ndarray, runs: Runs) -> Iterator[Runs]:
    """The runs, symbol by symbol; where a hash had deceived, what a direct scan finds at that lag."""
    for start, length, period in zip(*(x.tolist() for x in runs)):
        end = start + length
        whole = np.array_equal(symbols[start : end - period], symbols[start + period : end])
        whole = whole and (not start or symbols[start - 1] != symbols[start - 1 + period]) and (end == len(symbols) or symbols[end] != symbols[end - period])
        yield (np.array([start]), np.array([length]), np.array([period])) if whole else _scanned(symbols, period)


def runs_of(symbols: np.ndarray, sizes: np.ndarray) -> Runs:
    """Start, length and smallest period of all runs of at least two periods in texts of `sizes` symbols.

    `symbols` holds the texts one after the other, each followed by a symbol that occurs nowhere else.
    """
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    longest = int(sizes.max(initial=0))
    found = _joined([_scanned(symbols, lag) for lag in range(1, min(FIRST_SCALE, longest // 2 + 1))] or [tuple(np.zeros(0, np.int64) for _ in range(3))])
    scale = FIRST_SCALE
    while 2 * scale <= longest:
        # Shorter texts hold no two periods of this scale.
        mask = (sizes >= 2 * scale)[text]
        origin, place = np.flatnonzero(mask), np.cumsum(mask) - 1
        sequence = _Sequence(symbols[mask])
        own = mask[found[0]]
        known = (place[found[0][own]], found[1][own], found[2][own])
        parts = [known]
        for at, lag in _seeds(sequence, scale, known):
            start, end = sequence.extended(at, lag)
            long = end - start >= lag
            runs = np.unique(np.stack([start[long], (end - start + lag)[long], lag[long]]), axis=1)
            parts += _confirmed(sequence.symbols, tuple(runs))
        start, length, period = _joined(parts)
        found = _joined([tuple(x[~own] for x in found), (origin[start], length, period)])
        scale *= 2
    return found


# ---------------------------------------------------------------- texts


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """`words` of a text as the query changes them: in one of ten texts a last part repeats itself (see `edit`)."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


Edit = Callable[[int | None, list[bytes]], list[bytes]]


def _blocks(batches: Iterator[pa.RecordBatch], edit: Edit | None) -> Iterator[tuple[pa.RecordBatch, int, list[bytes], list[Runs]]]:
    """Slices of batches: the batch, where the slice starts, its texts' words (joined by a blank) and their runs."""
    for batch in batches:
        at, held, size = 0, [], 0
        for i, value in enumerate(batch.column(1)):
            parts = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
            if edit is not None:
                parts = edit(batch.column(0)[i].as_py(), parts)
            held.append(b" ".join(parts))
            size += len(parts)
            if size >= BLOCK_WORDS:
                yield batch, at, held, _runs_by_text(held)
                at, held, size = i + 1, [], 0
        if held:
            yield batch, at, held, _runs_by_text(held)


def _runs_by_text(texts: list[bytes]) -> list[Runs]:
    """Runs of each text, of at least `LEAST_WORDS` words, by start and then period; words are told apart by 64-bit hashes."""
    sizes = np.array([words.count(b" ") + 1 if words else 0 for words in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(int(ends[-1]), np.uint64)
    mask = np.ones(len(symbols), bool)
    mask[ends - 1] = False
    symbols[mask] = Windows(b" ".join([words for words in texts if words])).hashes(1)
    symbols[~mask] = mixed(np.arange(1, len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    start, length, period = runs_of(symbols, sizes)
    long = length >= LEAST_WORDS
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    starts = ends - sizes - 1
    cuts = np.searchsorted(start, np.concatenate([starts, ends[-1:]]))
    return [(start[a:b] - s, length[a:b], period[a:b]) for a, b, s in zip(cuts, cuts[1:], starts)]


def _kept(words: bytes, runs: Runs) -> bytes:
    """The words without those that a run holds after its first period."""
    if not len(runs[0]):
        return words
    parts = words.split(b" ")
    marks = np.zeros(len(parts) + 1, np.int64)
    np.add.at(marks, runs[0] + runs[2], 1)
    np.add.at(marks, runs[0] + runs[1], -1)
    return b" ".join([word for word, mark in zip(parts, np.cumsum(marks).tolist()) if not mark])


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Edit | None = None) -> DataFrame:
    """One row per run: the key, start (word number from 0), length, period (in words).

    Words are the runs of anything but white space; a run has at least 12 words and two periods. A null or empty text
    has none. Rows that repeat a key have their runs each.
    """
    schema = StructType([docs.select(key).schema[0], *(StructField(n, LongType()) for n in ("start", "length", "period"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, texts, found in _blocks(batches, edit):
            rows = np.repeat(np.arange(at, at + len(texts)), [len(f[0]) for f in found])
            columns = [pa.array(np.concatenate(x)) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs`; of each run in the text only the first period stays.

    A text without runs stays as it is; of others the words that stay are joined by one blank. Null stays null.
    """
    rest = [c for c in docs.columns if c != text]
    picked = docs.select(docs[key], docs[text], *[docs[c] for c in rest]).toDF("__key", "__text", *[f"__{i}" for i in range(len(rest))])
    schema = docs.select(*rest, text).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, texts, found in _blocks(batches, None):
            old = batch.column(1).slice(at, len(texts)).to_pylist()
            new = [_kept(words, own).decode("utf-8", "surrogatepass") if len(own[0]) else before for words, own, before in zip(texts, found, old)]
            yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[2:]), pa.array(new, pa.string())], names=schema.names)

    return picked.mapInArrow(run, schema).select(docs.columns)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Edit | None = None) -> DataFrame:
    """Per row: key, n_runs, the longest run (start, length, period, exponent_milli; ties: first start, then period;
    null without one), runs_sha256 (`start,length,period` and a line feed for each) and collapsed_sha256 (what stays).

    A null or empty text has no runs and two digests of the empty text. Every row counts, also where keys repeat.
    """
    numbers = ("n_runs", "start", "length", "period", "exponent_milli")
    schema = docs.select(key).schema
    for name in numbers:
        schema = schema.add(name, "long")
    schema = schema.add("runs_sha256", "string").add("collapsed_sha256", "string")

    def described(words: bytes, own: Runs) -> tuple:
        start, length, period = (x.tolist() for x in own)
        lines = "".join([f"{s},{n},{q}\n" for s, n, q in zip(start, length, period)])
        best = max(range(len(start)), key=lambda i: (length[i], -start[i], -period[i]), default=None)
        longest = (None,) * 4 if best is None else (start[best], length[best], period[best], 1000 * length[best] // period[best])
        return len(start), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_kept(words, own)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, texts, found in _blocks(batches, edit):
            columns = list(zip(*[described(words, own) for words, own in zip(texts, found)]))
            made = [*(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *made], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
