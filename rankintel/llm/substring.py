"""Removal of repeated passages, by difference-cover anchors.

A passage is a window of `WIDTH` consecutive words. Hashing every window of every document would shuffle a row per word.
Instead, short anchors are hashed only at word numbers whose remainder modulo a period lies in a difference cover: for
any two places where the same window starts there is one common offset at which both documents have an anchor inside
the window. Anchors that two documents share are thus found for every repeated window; from them the documents extend:
only windows around shared anchors are hashed whole, and the smallest document of each decides what goes.

Each step is one shuffle of narrow rows. A row stands for a document and an anchor (or window), once per document
however often it holds it, so that the most frequent anchor has no more rows than there are documents, of the many rows
of each. Texts are shuffled compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from rankintel.llm.words import Windows, words_of

WIDTH = 13
PERIOD, COVER = 7, (0, 1, 3)  # every difference modulo 7 is one of two members of the cover
ANCHOR_WORDS = WIDTH - PERIOD + 1


def cover_positions(n: int) -> np.ndarray:
    """Word numbers below `n` at which an anchor may start."""
    numbers = np.arange(n)
    return numbers[np.isin(numbers % PERIOD, COVER)]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _repeat(ids: list[int], sizes: list[int]) -> pa.Array:
    return pa.array(np.repeat(np.array(ids, np.int64), sizes))


def _concat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


ROWS_AT_ONCE = 500_000
NO_KEY = (1 << 63) - 1


def _rows(found: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size of (document, hash) from the hashes of each document."""
    ids, hashes, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_repeat(ids, [len(h) for h in hashes]), _longs(_concat(hashes))], names=["doc", "hash"])

    for own, values in found:
        ids.append(own)
        hashes.append(values)
        size += len(values)
        if size >= ROWS_AT_ONCE:
            yield batch()
            ids, hashes, size = [], [], 0
    yield batch()


def _keyed(docs: DataFrame, key: str, text: str, rest: list[str]) -> DataFrame:
    """doc, text and the struct `rest` of other columns; a null key comes after all others."""
    others = F.struct(*[docs[c] for c in rest]) if rest else F.lit(None).cast("struct<none:int>")
    return docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_KEY)).alias("doc"), docs[text].alias("text"), others.alias("rest"))


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    windows = Windows(words_of(text.as_py()))
                    if windows.count >= WIDTH:
                        yield doc, np.unique(windows.hashes(ANCHOR_WORDS, cover_positions(windows.count)))

        yield from _rows(found())

    return docs.select("doc", "text").mapInArrow(run, "doc long, hash long")


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(docs, hashes, where a hash begins) of rows in order of (hash, doc), cut between hashes.

    Only a hash of very many rows is cut within; the last value says that a piece may be a part of such a hash.
    """
    held: list[np.ndarray] | None = None

    def piece(own: list[np.ndarray], part: bool) -> tuple:
        doc, hashes = own
        return doc, hashes, np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])), part

    for batch in batches:
        own = [batch.column(i).to_numpy() for i in range(2)]
        if held is not None:
            own = [np.concatenate(pair) for pair in zip(held, own)]
        held = own
        if not len(own[0]):
            continue
        cut = int(np.searchsorted(own[1], own[1][-1]))  # where the last hash begins
        part = not cut
        if part:
            if len(own[0]) < ROWS_AT_ONCE:
                continue
            cut = len(own[0]) - 1
        yield piece([x[:cut] for x in own], part)
        held = [x[cut:] for x in own]
    if held is not None and len(held[0]):
        yield piece(held, False)


def _shared(rows: DataFrame) -> DataFrame:
    """(doc, hash) of the hashes that more than one document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_hash = None  # a hash of very many rows: it counts as shared
        for doc, hashes, starts, part in _runs_of(batches):
            ends = np.concatenate([starts[1:], [len(hashes)]])
            shared = doc[starts] != doc[ends - 1]
            shared[0] |= part or hashes[0] == cut_hash
            cut_hash = hashes[0] if part else None
            keep = np.repeat(shared, ends - starts)
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(hashes[keep])], names=["doc", "hash"])

    return rows.repartition("hash").sortWithinPartitions("hash", "doc").mapInArrow(run, "doc long, hash long")


def _packed(keyed: DataFrame) -> DataFrame:
    """Documents with their text compressed, as they go through a shuffle; null stays null."""
    schema = StructType([keyed.schema["doc"], StructField("packed", BinaryType()), keyed.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            packed = [pack(t.as_py().encode("utf-8", "surrogatepass")) if t.is_valid else None for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=schema.names)

    return keyed.mapInArrow(run, schema)


def _unpacked(value: bytes | None) -> bytes:
    """The words of a compressed text."""
    return b" ".join(zstandard.ZstdDecompressor().decompress(value).split()) if value else b""


def _windows(with_anchors: DataFrame) -> DataFrame:
    """(doc, hash) of the windows that hold a shared anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator:
            for batch in batches:
                for doc, packed, anchors in zip(batch.column("doc").to_pylist(), batch.column("packed"), batch.column("hashes")):
                    windows = Windows(_unpacked(packed.as_py()))
                    places = cover_positions(windows.count - ANCHOR_WORDS + 1)
                    hit = places[np.isin(windows.hashes(ANCHOR_WORDS, places).view(np.int64), anchors.values.to_numpy())]
                    marks = np.zeros(windows.count + 1, np.int32)
                    np.add.at(marks, np.maximum(0, hit - (WIDTH - ANCHOR_WORDS)), 1)
                    np.add.at(marks, hit + 1, -1)
                    at = np.flatnonzero(np.cumsum(marks)[: max(0, windows.count - WIDTH + 1)] > 0)
                    yield doc, np.unique(windows.hashes(WIDTH, at))

        yield from _rows(found())

    return with_anchors.mapInArrow(run, "doc long, hash long")


def _later(rows: DataFrame) -> DataFrame:
    """(doc, hash) of the windows that a document with a smaller key has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_hash, cut_first = None, 0
        for doc, hashes, starts, part in _runs_of(batches):
            first = doc[starts].copy()
            if hashes[0] == cut_hash:
                first[0] = cut_first
            cut_hash, cut_first = (hashes[0], first[0]) if part else (None, 0)
            keep = doc > np.repeat(first, np.diff(np.concatenate([starts, [len(doc)]])))
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(hashes[keep])], names=["doc", "hash"])

    return rows.repartition("hash").sortWithinPartitions("hash", "doc").mapInArrow(run, "doc long, hash long")


def _kept(words: bytes, repeated: np.ndarray) -> np.ndarray:
    """A mask of the words that no window with one of the hashes covers."""
    windows = Windows(words)
    marks = np.zeros(windows.count + 1, np.int32)
    at = np.flatnonzero(np.isin(windows.hashes(WIDTH).view(np.int64), repeated))
    marks[at] += 1
    marks[at + WIDTH] -= 1
    return np.cumsum(marks)[:-1] == 0


def marked(keyed: DataFrame) -> DataFrame:
    """doc, packed text, rest, and `hashes` of the windows in it that a document with a smaller key has too (null: none).

    Both joins deal the compressed texts out by the same key, so they go through one shuffle. The lists that are
    gathered hold at most a document's own anchors or windows.
    """
    packed = _packed(keyed)
    shared = _shared(_anchors(keyed)).groupBy("doc").agg(F.collect_list("hash").alias("hashes"))
    later = _later(_windows(packed.join(shared, "doc")))
    return packed.join(later.groupBy("doc").agg(F.collect_list("hash").alias("hashes")), "doc", "left")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256 of every row.

    Removed is each word covered by a window of 13 words that also starts in a document with a smaller key. A null
    text has no words; documents of fewer words than a window keep them all; a null key comes after all others. Rows
    that repeat a key are never repeats of each other.
    """
    schema = docs.select(docs[key].cast(LongType()).alias(key)).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests = [], [], []
            for packed, hashes in zip(batch.column(1), batch.column(2)):
                words = _unpacked(packed.as_py())
                counts.append(words.count(b" ") + 1 if words else 0)
                removed.append(0)
                if hashes.is_valid:
                    keep = _kept(words, hashes.values.to_numpy())
                    removed[-1] = int((~keep).sum())
                    words = b" ".join([w for w, k in zip(words.split(b" "), keep.tolist()) if k])
                digests.append(hashlib.sha256(words).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=schema.names)

    found = marked(_keyed(docs, key, text, []))
    # `rest` stays, unused: a plan that drops it here would not share the shuffle of the texts.
    return found.select(F.when(F.col("doc") != NO_KEY, F.col("doc")).alias(key), "packed", "hashes", "rest").mapInArrow(run, schema)


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs`, the text without its repeated words; a text of which nothing goes stays as it is.

    Of the other texts the words that stay are joined by one blank. A null text stays null.
    """
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest, text).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = []
            for packed, hashes in zip(batch.column(len(rest)), batch.column(len(rest) + 1)):
                whole = unpack(packed.as_py()) if packed.is_valid else None
                if whole is not None and hashes.is_valid:
                    parts = whole.split()
                    keep = _kept(b" ".join(parts), hashes.values.to_numpy())
                    if not keep.all():
                        whole = b" ".join([w for w, k in zip(parts, keep.tolist()) if k])
                texts.append(whole.decode("utf-8", "surrogatepass") if whole is not None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], names=schema.names)

    # The other columns travel with the text, so that rows which repeat a key keep what is theirs.
    found = marked(_keyed(docs, key, text, rest))
    # They go to the task by place, so that their names can be any.
    return found.select(*[F.col("rest")[c].alias(f"__{i}") for i, c in enumerate(rest)], "packed", "hashes").mapInArrow(run, schema).select(docs.columns)
