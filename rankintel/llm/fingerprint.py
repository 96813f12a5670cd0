"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; where its upper bits are zero a chunk may end. Chunk lengths are
normalised: up to the wanted length more zero bits are asked for, beyond it fewer. Boundaries depend on the bytes just
before them alone, so an insertion shifts the text but not the chunks behind it. A fingerprint is the set of chunk
digests with the chunks' lengths as weights; the share of that weight which another fingerprint also holds measures
containment.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunk lengths in bytes, and zero bits asked for before and after the wanted length.
SHORTEST, WANTED, LONGEST = 24, 64, 256
BITS_BEFORE, BITS_AFTER = 8, 4
WINDOW = 64
SEED = 20
#: Rows that are neighbours by key and are handled by one task; most runs of rows that the driver keeps a bound of.
RUN_ROWS, MOST_RUNS = 500, 4_096

GEAR = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)


def _rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, over the `WINDOW` bytes that end there."""
    rolled, width = GEAR[data], 1
    while width < WINDOW:
        add = rolled[:-width] << np.uint64(width)
        rolled = np.concatenate([rolled[:width], rolled[width:] + add])
        width *= 2
    return rolled


def chunk_ends(data: bytes, start: int = 0) -> list[int]:
    """Where chunks end, from a chunk that begins at `start` on."""
    size = len(data)
    if start >= size:
        return []
    skipped = max(0, start - WINDOW)
    rolled = _rolled(np.frombuffer(data, np.uint8)[skipped:])
    likely = np.flatnonzero(rolled >> np.uint64(64 - BITS_AFTER) == 0)
    strict = likely[rolled[likely] >> np.uint64(64 - BITS_BEFORE) == 0]
    likely, strict = (likely + skipped + 1).tolist(), (strict + skipped + 1).tolist()
    likely.append(size + LONGEST)
    strict.append(size + LONGEST)
    ends = []
    while size - start > SHORTEST:
        end = strict[bisect_left(strict, start + SHORTEST)]
        if end > start + WANTED:
            end = min(likely[bisect_left(likely, start + WANTED)], start + LONGEST, size)
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


Chunks = dict[bytes, int]


def _digests(data: bytes, start: int, ends: list[int]) -> Chunks:
    out = {}
    for end in ends:
        out[hashlib.blake2b(data[start:end], digest_size=8).digest()] = end - start
        start = end
    return out


def chunks_of(data: bytes) -> Chunks:
    """Digest and length of each distinct chunk."""
    return _digests(data, 0, chunk_ends(data))


def written(chunks: Chunks) -> str:
    """A fingerprint as text: 16 hex digits of digest and 3 of length for each chunk, in order of digest."""
    return "".join([f"{digest.hex()}{length:03x}" for digest, length in sorted(chunks.items())])


def containment(own: Chunks, other: Chunks) -> float:
    """The share of `own`'s weight that `other` holds too; of nothing, 1 in nothing and 0 in anything else."""
    total = sum(own.values())
    if not total:
        return float(not other)
    return sum(own[digest] for digest in own.keys() & other.keys()) / total


def edited(text: str, following: str) -> tuple[str, int]:
    """`text` with its last quarter replaced by as much of `following`, and how many code points are its own."""
    replaced = len(text) // 4
    kept = len(text) - replaced
    return text[:kept] + following[:replaced], kept


class Document:
    """A text with its chunks."""

    def __init__(self, key: object, text: str | None) -> None:
        self.key, self.text = key, text or ""
        self.data = self.text.encode("utf-8", "surrogatepass")
        self.ends = chunk_ends(self.data)
        self.chunks = _digests(self.data, 0, self.ends)

    def compared(self, following: "Document") -> tuple:
        changed, kept = edited(self.text, following.text)
        data = changed.encode("utf-8", "surrogatepass")
        # Chunks that end before the edit are those of the text itself.
        same = len(changed[:kept].encode("utf-8", "surrogatepass")) if not self.text.isascii() else kept
        ends = self.ends[: bisect_left(self.ends, same)]
        start = ends[-1] if ends else 0
        other = _digests(data, 0, ends) | _digests(data, start, chunk_ends(data, start))
        return (
            self.key,
            len(self.text),
            hashlib.sha256(data).hexdigest(),
            written(self.chunks),
            written(other),
            containment(self.chunks, other),
            containment(self.chunks, following.chunks),
        )


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _runs(docs: DataFrame, run_rows: int, most_runs: int) -> DataFrame:
    """`__run`, `__tail`, `__key`, `__tie`, `__text`: rows in runs of neighbouring keys, the first of the next run as tail."""
    n = docs.count()
    wanted = min(most_runs, max(1, n // run_rows))
    bounds = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        bounds = sorted({b for b in docs.select(F.percentile_approx("__key", F.lit(shares).cast("array<double>"), 4 * most_runs)).first()[0] or [] if b is not None})

    @F.pandas_udf(T.IntegerType())
    def run_of(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = pd.Series(0, index=keys.index, dtype="int32")
        out[known] = np.searchsorted(bounds, keys[known].to_numpy(), side="right")
        return out

    placed = docs.withColumn("__run", run_of("__key") if bounds else F.lit(0))
    first = placed.groupBy("__run").agg(F.min(F.struct("__key", "__tie")).alias("first")).orderBy("__run").collect()  # one row per run
    heads = [(r["first"]["__key"], r["first"]["__tie"], first[i - 1]["__run"]) for i, r in enumerate(first)]
    schema = T.StructType([docs.schema["__key"], docs.schema["__tie"], T.StructField("__before", T.IntegerType())])
    heads = docs.sparkSession.createDataFrame(heads, schema).withColumnRenamed("__key", "__k").withColumnRenamed("__tie", "__t")
    # One row per run, at most `most_runs`: small at any size of the input, and the texts stay where they are.
    met = placed.join(F.broadcast(heads), placed["__key"].eqNullSafe(heads["__k"]) & (placed["__tie"] == heads["__t"]), "left")
    own = F.struct(F.col("__run").alias("run"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("__before").alias("run"), F.lit(True).alias("tail"))
    at = F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, tail)))
    return met.select(at.alias("at"), "__key", "__tie", "__text").select("at.run", "at.tail", "__key", "__tie", "__text")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", run_rows: int = RUN_ROWS, most_runs: int = MOST_RUNS) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next row is the one that follows by key (null keys come first, equal keys go by a hash of their text); the
    last is followed by the first. A null text is the empty text, whose fingerprint is empty. Repeated rows follow
    each other.
    """
    picked = docs.select(docs[key].alias("__key"), F.xxhash64(docs[text]).alias("__tie"), docs[text].alias("__text"))
    placed = _runs(picked, run_rows, most_runs).repartition("run").sortWithinPartitions("run", "tail", "__key", "__tie")
    schema = docs.select(key).schema
    for column in COLUMNS.split(", "):
        schema = schema.add(*column.split(" "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_run = None, None  # the row that waits for its follower

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                arrow = pa.schema([pa.field(schema[0].name, batch.schema.field(2).type), *(pa.field(f.name, k) for f, k in zip(schema.fields[1:], kinds))])
            rows, size = [], 0
            for i in range(batch.num_rows):
                own, is_tail = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if is_tail and (held is None or own != held_run):
                    continue  # a repeated first row
                document = Document(batch.column(2)[i].as_py(), batch.column(4)[i].as_py())
                if held is not None:
                    rows.append(held.compared(document))
                    size += len(held.data)
                held, held_run = (None, None) if is_tail else (document, own)
                if size > 8_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return placed.mapInArrow(run, schema)
