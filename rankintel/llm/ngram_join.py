"""Exact Jaccard join of documents on word shingles: size-banded tiles with bitmap signatures.

Documents with equal shingle sets are one node. A pair of nodes that is similar enough shares several shingles among the
rarest few of each, so nodes meet in the tile of each such shingle; there, only nodes of comparable size are compared,
and a node that meets others in fewer tiles than a similar pair must have in common goes before anything is compared.
A signature holds the parity of the number of shingles per bit: where two signatures differ, the sets differ, which
bounds their overlap from above by a bit count. Pairs that pass are counted exactly on their sorted shingle arrays.

Only components are asked for, so each tile is linked in two steps. First its nodes are checked against few others (the
neighbour in size order, the first of the band); what that links falls together. Then all pairs of different
components are compared, which is exhaustive and leaves a large group of near copies with almost nothing to compare.
Large tiles are cut into chunks, and pairs of chunks go to tasks of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankintel.llm.components import components
from rankintel.llm.shared import bounded_batches, sliced, stored
from rankintel.llm.words import Windows, words_of

SHINGLE_WORDS = 4
#: Similar are two sets if 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Shingles are ordered by how frequent their bucket is; buckets number four a document, within 2^these bits.
ORDER_BITS = (20, 24)
#: So many tiles a pair of similar nodes has in common, at least (fewer, if the sets are small).
SHARED_TILES = 8
#: Bits of a signature: at least so many, then one for each shingle (up to a power of two), at most so many.
LEAST_BITS, MOST_BITS = 64, 16_384
CHUNK_NODES = 512
#: Parts that the documents of one set are dealt into while their first is looked up.
SALTS = 64


def shingles(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles (A-Z in lower case); of all its words, if they are fewer."""
    windows = Windows((text if isinstance(text, bytes) else words_of(text)).lower())
    return np.unique(windows.hashes(min(SHINGLE_WORDS, windows.count))) if windows.count else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> bytes:
    """Parity of the number of hashes per bit; wider for larger sets. A wider one folds into a narrower one by xor."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, len(hashes) - 1).bit_length()))
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.intp), minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.intp)


def _levels(docs: DataFrame) -> np.ndarray:
    """For each bucket of shingles, the magnitude of its number of occurrences, if it stands out, else 0.

    Any order of shingles gives the same result; this one keeps the frequent ones out of the tiles. Each task reports
    the buckets that stand out among its documents, and their counts are added up over all documents.
    """
    bits = min(ORDER_BITS[1], max(ORDER_BITS[0], (4 * docs.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, _bucket(shingles(text.as_py()), bits), 1)
        found = np.flatnonzero(counts > 8 + 2 * counts.mean())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], names=["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    levels = np.zeros(1 << bits, np.uint8)
    rows = counted.toPandas()  # at most 2^bits rows, and as many bytes are sent to the tasks
    levels[rows["bucket"].to_numpy(np.int64)] = np.log2(rows["n"].to_numpy(np.float64)).astype(np.uint8)
    return levels


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _least_common(n: int) -> int:
    """How many shingles a set of `n` has in common with any similar one, at least."""
    return -(-PERCENT * n // 100)


def rarest(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles by which a set must meet similar ones, in `SHARED_TILES` tiles or as many as it has in common.

    All but `_least_common` of its shingles may be missing in a similar set; so many more of the rarest are taken that
    the given number of those in common is among them.
    """
    common = _least_common(len(hashes))
    bits = len(levels).bit_length() - 1
    return hashes[np.lexsort((hashes, levels[_bucket(hashes, bits)]))[: len(hashes) - common + min(SHARED_TILES, common)]]


def _sets(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc, n, digest of the set, signature, and the rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 1):
                sets = [shingles(text.as_py()) for text in batch.column(1)]
                sizes = pa.array([len(h) for h in sets], pa.int32())
                made = [pa.array([f(h) for h in sets], pa.binary()) for f in (_digest, signature, lambda h: rarest(h, levels).tobytes())]
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *made], names=["doc", "n", "digest", "signature", "rare"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, n int, digest binary, signature binary, rare binary")


def _first_of_set(linked: DataFrame) -> DataFrame:
    """doc, n, digest, rep: the smallest document with the same set.

    The documents of a set are dealt into `SALTS` parts, and only the parts' smallest are gathered by set, so that a
    set which a third of all documents have is nowhere in one task.
    """
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt")
    salted = linked.select("doc", "n", "digest", salt)
    parts = salted.groupBy("digest", "salt").agg(F.min("doc").alias("first"))
    named = parts.join(parts.groupBy("digest").agg(F.min("first").alias("rep")), "digest").select("digest", "salt", "rep")
    return salted.join(named, ["digest", "salt"]).select("doc", "n", "digest", "rep")


def _rare(nodes: DataFrame) -> DataFrame:
    """key, doc, n: each node by its rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 2):
                keys = [np.frombuffer(rare.as_py(), np.int64) for rare in batch.column(2)]
                times = [len(k) for k in keys]
                docs, sizes = (np.repeat(batch.column(i).to_numpy(), times) for i in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(docs), pa.array(sizes)], names=["key", "doc", "n"])

    return nodes.select("doc", "n", "rare").mapInArrow(run, "key long, doc long, n int")


def _comparable(small: str, large: str) -> str:
    return f"{small} * 100L >= {large} * {PERCENT}L"


def _tiles(rare: DataFrame) -> DataFrame:
    """key, doc, n: nodes by shingle, where another node of comparable size has it too."""
    order = Window.partitionBy("key").orderBy("n", "doc")
    beside = rare.select("*", F.lag("n").over(order).alias("less"), F.lead("n").over(order).alias("more"))
    return beside.where(f"({_comparable('less', 'n')}) OR ({_comparable('n', 'more')})").select("key", "doc", "n")


def _met_often(tiles: DataFrame) -> DataFrame:
    """The tiles without nodes that are in fewer of them than a similar pair has in common.

    A node of `n` shingles has `SHARED_TILES` with each similar node, or as many as the smallest of these must have in
    common with it.
    """
    least = F.ceil(F.ceil(F.col("n") * PERCENT / 100) * PERCENT / 100)
    counted = tiles.withColumn("tiles", F.count("*").over(Window.partitionBy("doc")))
    return counted.where(F.col("tiles") >= F.least(F.lit(SHARED_TILES), least)).select("key", "doc", "n")


def _different(tiles: DataFrame) -> DataFrame:
    """The tiles without those that hold the same nodes as another one.

    Near copies share many rare shingles, each with a tile of the same nodes, and one of these is enough. Node sets are
    told apart by four sums of hashes (128 bits), their number and their smallest and largest member.
    """
    hashes = [F.xxhash64("doc", "n"), F.xxhash64("n", "doc", F.lit(1))]
    halves = [half for h in hashes for half in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    sums = [F.sum(half).alias(f"s{i}") for i, half in enumerate(halves)]
    members = tiles.groupBy("key").agg(F.count("*").alias("size"), F.min("doc").alias("low"), F.max("doc").alias("high"), *sums)
    one = members.groupBy([c for c in members.columns if c != "key"]).agg(F.min("key").alias("key")).select("key")
    return tiles.join(one, "key", "left_semi")


def _first_pairs(tiles: DataFrame) -> DataFrame:
    """a < b: each node of a tile with its neighbour in size order, the first of its size band and the oldest of all.

    In a group of near copies the oldest is often the original, which has more in common with each copy than the
    copies have with each other.
    """
    band = F.floor(F.log("n") / math.log(100 / PERCENT)).alias("band")
    order = Window.partitionBy("key").orderBy("n", "doc")
    banded = tiles.select("*", band, F.lag("doc").over(order).alias("before"))
    first = F.first("doc").over(Window.partitionBy("key", "band").orderBy("n", "doc").rowsBetween(Window.unboundedPreceding, 0))
    oldest = F.min("doc").over(Window.partitionBy("key"))
    others = F.explode(F.array("before", "first", "oldest"))
    both = banded.select("doc", "before", first.alias("first"), oldest.alias("oldest")).select("doc", others.alias("other")).where("doc <> other")
    return both.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def _arrays(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc and sorted shingles of the documents that are in a pair (a, b)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            packed = [own(words_of(text.as_py()).lower()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes = [shingles(unpack(words.as_py())).tobytes() for words in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.binary())], names=["doc", "hashes"])

    packed = docs.select("doc", "text").mapInArrow(pack, "doc long, packed binary")
    wanted = stored(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "paired")
    return stored(packed.join(wanted, "doc", "left_semi").mapInArrow(run, "doc long, hashes binary"), "arrays")


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the size and signature bounds."""
    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")]).astype(np.int64)
            signatures = batch.column("sa").to_pylist() + batch.column("sb").to_pylist()
            keep = _passing(np.arange(2 * m), n, signatures, np.arange(m), np.arange(m, 2 * m))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _similar(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, counted exactly."""
    left = arrays.select(F.col("doc").alias("a"), F.col("hashes").alias("ha"))
    right = arrays.select(F.col("doc").alias("b"), F.col("hashes").alias("hb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(x.as_py(), np.uint64) for x in (one, two))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _passing(own: np.ndarray, n: np.ndarray, signatures: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the index pairs differ in component and pass the size and signature bounds."""
    small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
    passes = (own[left] != own[right]) & (small * 100 >= large * PERCENT)
    left, right, at = left[passes], right[passes], np.flatnonzero(passes)
    widths = np.array([len(s) for s in signatures])
    width = np.minimum(widths[left], widths[right])
    for w in np.unique(width):
        chosen = np.flatnonzero(width == w)
        used = np.unique(np.concatenate([left[chosen], right[chosen]]))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(signatures[i], np.uint8).reshape(-1, w), axis=0) for i in used])
        place = np.zeros(len(n), np.intp)
        place[used] = np.arange(len(used))
        for part in np.array_split(chosen, max(1, len(chosen) * int(w) // 16_000_000 + 1)):
            a, b = left[part], right[part]
            apart = np.bitwise_count(folded[place[a]] ^ folded[place[b]]).sum(1, dtype=np.int64)
            passes[at[part[(200 - 100 + PERCENT) * apart > (100 - PERCENT) * (n[a] + n[b])]]] = False
    return passes


def _compare(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one pair of chunks; `side` is 0, 1, or 2 for rows of a chunk that meets itself."""
    doc, n, own, side = (rows.column(c).to_numpy() for c in ("doc", "n", "own", "side"))
    n, signatures = n.astype(np.int64), rows.column("signature").to_pylist()
    if side[0] == 2:
        left, right = np.triu_indices(len(doc), 1)
    else:
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = np.repeat(one, len(two)), np.tile(two, len(one))
    keep = _passing(own, n, signatures, left, right)
    a, b = doc[left[keep]], doc[right[keep]]
    return np.minimum(a, b), np.maximum(a, b)


def _cross_pairs(tiles: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """a < b: pairs of one tile but of different components that pass the bounds."""
    own = F.coalesce("component", "doc").alias("own")
    placed = tiles.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", own)
    # The only pair of a tile of two is one of neighbours, which has been checked.
    members = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("own").alias("low"), F.max("own").alias("high"))
    open_ = placed.join(members.where("size > 2 AND low < high").select("key", "size"), "key")
    # Members of a component stand together, so that the chunks of a large one have nothing to compare among themselves.
    number = F.row_number().over(Window.partitionBy("key").orderBy("own", "n", "doc"))
    chunked = open_.withColumn("chunk", F.floor((number - 1) / CHUNK_NODES))
    chunked = stored(chunked, "chunks")
    whole = chunked.where(F.col("size") <= CHUNK_NODES).select("key", F.col("chunk").alias("chunk_l"), F.col("chunk").alias("chunk_r"), F.lit(2).alias("side"), "doc", "n", "own")
    chunked = chunked.where(F.col("size") > CHUNK_NODES)
    spans = chunked.groupBy("key", "chunk").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("own").alias("o0"), F.max("own").alias("o1"))
    left, right = (spans.select("key", *[F.col(c).alias(f"{c}{s}") for c in ("chunk", "n0", "n1", "o0", "o1")]) for s in ("_l", "_r"))
    met = left.join(right, "key").where("chunk_l <= chunk_r").where(f"({_comparable('n0_l', 'n1_r')} OR n0_l <= n1_r) AND ({_comparable('n1_l', 'n0_r')} OR n1_l >= n0_r)")
    met = met.where("NOT (o0_l = o1_l AND o0_r = o1_r AND o0_l = o0_r)").select("key", "chunk_l", "chunk_r")
    sides = met.select(
        "*",
        F.explode(
            F.when(F.col("chunk_l") == F.col("chunk_r"), F.array(F.struct(F.col("chunk_l").alias("chunk"), F.lit(2).alias("side")))).otherwise(
                F.array(F.struct(F.col("chunk_l").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("chunk_r").alias("chunk"), F.lit(1).alias("side")))
            )
        ).alias("at"),
    ).select("key", "chunk_l", "chunk_r", F.col("at.chunk").alias("chunk"), F.col("at.side").alias("side"))
    rows = whole.union(chunked.join(sides, ["key", "chunk"]).select("key", "chunk_l", "chunk_r", "side", "doc", "n", "own"))
    rows = rows.join(sets, ["doc", "n"]).select("key", "chunk_l", "chunk_r", "side", "doc", "n", "own", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            marks = [table.column(i).to_numpy() for i in range(3)]
            change = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
            edges = [0, *change.tolist()] + ([table.num_rows] if last else [])
            return [table.slice(s, e - s) for s, e in zip(edges, edges[1:])], table.slice(edges[-1])

        def compared(parts: list[pa.Table]) -> pa.RecordBatch:
            pairs = [_compare(part) for part in parts if part.num_rows > 1]
            columns = [np.concatenate(x) for x in zip(*pairs)] if pairs else [np.zeros(0, np.int64)] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                own = pa.Table.from_batches([batch])
                parts, held = groups(pa.concat_tables([held, own]).combine_chunks() if held is not None else own, False)
                yield compared(parts)
        if held is not None:
            yield compared(groups(held, True)[0])

    dealt = rows.repartition("key", "chunk_l", "chunk_r").sortWithinPartitions("key", "chunk_l", "chunk_r")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links, itself included) of every row.

    Texts without words (null, empty, blank) have no shingles and no links. Rows that repeat a key are one document
    that links wherever one of them links. A null key takes no part in links, and its component is null.
    """
    bounded_batches(docs.sparkSession)
    picked = docs.select(docs[key].cast("long").alias("doc"), docs[text].alias("text"))
    sets = stored(_sets(picked, _levels(picked)), "sets")
    linked = stored(_first_of_set(sets.where("n > 0 AND doc IS NOT NULL")), "linked")
    # Rows that repeat a key have a node each where their sets differ; all go by the key.
    reps = linked.where("doc = rep").select("doc", "n", "digest").distinct()
    nodes = sets.join(reps, ["doc", "n", "digest"], "left_semi")
    tiles = stored(_tiles(_met_often(_tiles(_rare(nodes.dropDuplicates(["doc", "n", "digest"]))))), "all-tiles")
    tiles = stored(_different(tiles), "tiles")
    cards = sets.select("doc", "n", "signature").join(tiles.select("doc", "n").distinct(), ["doc", "n"], "left_semi")
    cards = stored(cards.dropDuplicates(["doc", "n", "signature"]), "signatures")

    def similar(likely: DataFrame) -> DataFrame:
        pairs = stored(likely, "likely")
        return stored(_similar(pairs, _arrays(picked, pairs)), "pairs")

    links = similar(_likely(stored(_first_pairs(tiles), "first"), cards))
    stars = components(links)
    more = similar(_cross_pairs(tiles, stars, cards))
    # Rows of one key with different texts join their nodes: the key's own node is another name for each.
    same = linked.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    several = linked.select("doc", "digest").distinct().groupBy("doc").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("doc").alias("a"))
    found = components(stars.union(more).union(same.join(several, "a", "left_semi")), *stars.columns)

    named = linked.select("doc", "n", F.col("rep").alias("node")).unionByName(sets.where("n = 0 OR doc IS NULL").select("doc", "n", F.lit(None).cast("long").alias("node")))
    named = named.join(found, "node", "left")
    return named.select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "node", "doc")).alias("component_id"))
