"""Packing tokenised documents into sequences of bounded length by bin completion.

Only lengths matter for where a piece can go, so the problem that is searched is the histogram of lengths: at most
`capacity` counts, whatever the number of documents. Around the largest length that is left, the undominated fillings
are enumerated, the best is taken as often as the counts allow, branches are pruned by the waste that a better packing
may still leave, and best-fit packings of what is left are the incumbents. The plan that comes out (a list of fillings
and how often each is used) names for the r-th piece of each length its sequence and its offset; ranks within a length
are counted in salted groups, so a length that a third of all pieces have is spread out like any other.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankintel.llm.shared import stored

# Fixed value: how the vocabulary's file cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

CAPACITY = 4096
END_ID = 1
RANK_GROUPS = 256
#: Branches that the search may open before it settles for its incumbent.
SEARCH_NODES = 24
#: Bytes of words and ids that an encoder remembers, about; it lives as long as its task.
CACHE_BYTES = 96_000_000
ENTRY_BYTES = 240

PIECES = "piece integer, start long, length long, ids_crc32 long"

# ---------------------------------------------------------------- tokens


@lru_cache(maxsize=1)
def _library(path: str):
    """The vocabulary file as the tokenizers library holds it, once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of a lower-casing word vocabulary of the tokenizers library, with the words met before remembered.

    White space never joins two units of text, so each unit is encoded once. Units of Latin-1 letters are normalised
    here and their words given to the library's model; all others go through the whole library. What a text holds of
    either is asked once for the whole text, and a unit that is a word already is remembered once.
    """

    def __init__(self, path: str) -> None:
        self._library = _library(path)
        self._model = self._library.model.tokenize
        self._special = tuple(t.content for t in self._library.get_added_tokens_decoder().values())
        self._words = regex.compile(PATTERN).findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self._letters = {chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self._letters = str.maketrans(self._letters)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, bytes] = {"": b""}  # of units and of words: a word is the only one of its unit
        self.held = 0  # its bytes, about

    def _keep(self, unit: str, ids: bytes) -> bytes:
        self.held += ENTRY_BYTES + 2 * len(unit) + len(ids)
        self._known[unit] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self._known.get(word)
        if ids is None:
            letters = word if word.isascii() and word.isprintable() else word.translate(self._letters)
            ids = self._keep(word, array("I", [token.id for token in self._model(letters)]).tobytes())
        return ids

    def _plain(self, text: str) -> bool:
        """Whether the text is of Latin-1 characters only, and holds no special token."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(s in text for s in self._special)

    def _unit(self, unit: str, plain: bool) -> bytes:
        ids = self._known.get(unit)
        if ids is not None:  # met earlier in this text
            return ids
        if plain or self._plain(unit):
            low = unit.lower()
            if low.isalpha():
                ids = self._word(low)
            elif low[-1] in ".," and low[:-1].isalpha():
                ids = self._word(low[:-1]) + self._word(low[-1])
            else:
                ids = b"".join(map(self._word, self._words(low)))
        else:
            ids = array("I", self._library.encode(unit, add_special_tokens=False).ids).tobytes()
        return ids if unit in self._known else self._keep(unit, ids)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; null is the empty text."""
        text = text or ""
        units = text.replace("\n", " ").split(" ")
        ids = [*map(self._known.get, units)]
        if None in ids:
            plain = self._plain(text)
            for i in [i for i, own in enumerate(ids) if own is None]:
                if self.held > CACHE_BYTES:
                    self._forget()
                ids[i] = self._unit(units[i], plain)
        return b"".join(ids)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: ids of the text, then `end_id`, cut where `capacity` is reached."""
    schema = docs.select(key).schema
    for column in PIECES.split(", "):
        schema = schema.add(*column.split(" "))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(path).encode
        for batch in batches:
            row, part, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = encode(value.as_py()) + end
                for k in range(0, len(ids), 4 * capacity):
                    own = ids[k : k + 4 * capacity]
                    row.append(i)
                    part.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(part, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


# ---------------------------------------------------------------- search

Filling = tuple[tuple[int, int], ...]  # (length, copies), the largest first
Packing = list[tuple[Filling, int]]  # how often each filling is used


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best fit, longest first; sequences that are filled alike are handled together."""
    open_: dict[int, list[tuple[Filling, int]]] = {}  # by room left
    rooms: list[int] = []
    done: Packing = []

    def put(filling: Filling, used: int, room: int) -> None:
        if not room:
            done.append((filling, used))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((filling, used))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                filling, used = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                filling, used, room = (), left, capacity
            copies = room // length
            whole = min(used, left // copies)
            if whole:
                put((*filling, (length, copies)), whole, room - copies * length)
                left -= whole * copies
                used -= whole
            if used and left and left < copies:
                put((*filling, (length, left)), 1, room - left * length)
                left, used = 0, used - 1
            if used and filling:
                put(filling, used, room)
    return done + [entry for group in open_.values() for entry in group]


def size_of(packing: Packing) -> int:
    return sum(used for _, used in packing)


def fillings(counts: dict[int, int], capacity: int, waste: int, most: int = 16) -> list[Filling]:
    """Undominated fillings around the largest length, least waste first; none wastes more than `waste`.

    A filling is dominated if a length left outside fits in the place of a shorter one, or of two that are together
    no longer: what the exchange frees is never harder to place.
    """
    lengths = sorted(counts, reverse=True)
    found: list[tuple[int, Filling]] = []
    steps = 0

    def dominated(inside: dict[int, int], room: int) -> bool:
        own = [x for x in inside if x != lengths[0]]
        outside = [x for x in lengths if counts[x] > inside.get(x, 0)]
        sums = own + [a + b for i, a in enumerate(own) for b in own[i:] if a != b or inside[a] > 1]
        for total in sums:
            single = total in inside
            if any((total < x if single else total <= x) and x <= total + room for x in outside):
                return True
        return False

    def extend(at: int, room: int, inside: dict[int, int]) -> None:
        nonlocal steps
        steps += 1
        if steps > 50 * most or len(found) >= most:
            return
        while at < len(lengths) and lengths[at] > room:
            at += 1
        if at == len(lengths):
            if room <= waste and not dominated(inside, room):
                found.append((room, tuple(sorted(inside.items(), reverse=True))))
            return
        length = lengths[at]
        for copies in range(min(room // length, counts[length] - inside.get(length, 0)), -1, -1):
            extend(at + 1, room - copies * length, inside | ({length: inside.get(length, 0) + copies} if copies else {}))

    extend(0, capacity - lengths[0], {lengths[0]: 1})
    return [filling for _, filling in sorted(found, key=lambda x: x[0])]


def pack_counts(counts: dict[int, int], capacity: int, nodes: int = SEARCH_NODES) -> Packing:
    """As few sequences as the search finds for so many pieces of each length."""
    counts = {length: n for length, n in counts.items() if n}
    total = sum(length * n for length, n in counts.items())
    least = max(-(-total // capacity), sum(n for length, n in counts.items() if 2 * length > capacity))
    best = best_fit(counts, capacity)
    opened = 0
    stack: list[tuple[dict[int, int], Packing, int]] = [(counts, [], 0)]  # left, taken so far, wasted so far
    while stack and size_of(best) > least and opened < nodes:
        left, taken, wasted = stack.pop()
        opened += 1
        rest = best_fit(left, capacity)
        if size_of(taken) + size_of(rest) < size_of(best):
            best = taken + rest
        allowed = (size_of(best) - 1) * capacity - total - wasted
        if not left or allowed < 0:
            continue
        branches = []
        for filling in fillings(left, capacity, allowed):
            used = min(left[length] // copies for length, copies in filling)
            waste = capacity - sum(length * copies for length, copies in filling)
            if waste:
                used = min(used, allowed // waste)
            remaining = {length: n - used * dict(filling).get(length, 0) for length, n in left.items()}
            branches.append(({k: n for k, n in remaining.items() if n}, [*taken, (filling, used)], wasted + used * waste))
        stack.extend(reversed(branches))
    return best


# ---------------------------------------------------------------- placing


def _places(packing: Packing) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and where they go; in order of (length, first rank)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, used in packing:
        offset = 0
        for length, copies in filling:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, copies, offset))
            taken[length] = first + used * copies
            offset += length * copies
        sequence += used
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "copies", "offset"), table.T))


def place(table: DataFrame, order: tuple[str, ...], capacity: int = CAPACITY, nodes: int = SEARCH_NODES, groups: int = RANK_GROUPS) -> DataFrame:
    """`table` (pieces with a `length` of 1 to `capacity`) with `sequence_id` and `offset`.

    `table` should be a stored one: it is read for the histogram, for the ranks and for the result.
    """
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if counts and not (min(counts) >= 1 and max(counts) <= capacity):
        raise ValueError(f"a piece must have 1 to {capacity} tokens")
    places = _places(pack_counts(counts, capacity, nodes))

    grouped = table.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    sizes = grouped.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("length", "__group").orderBy(*order)
    ranked = grouped.withColumn("__own", F.row_number().over(own)).join(bases, ["length", "__group"])
    ranked = ranked.select(*table.columns, (F.col("__base") + F.col("__own") - 1).alias("__rank"))

    schema = StructType([*table.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    at_length, at_rank = table.columns.index("length"), len(table.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = places["length"] << 44 | places["first"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (at_length, at_rank))
            at = np.searchsorted(starts, length << 44 | rank, side="right") - 1
            within, copies = rank - places["first"][at], places["copies"][at]
            sequence = places["sequence"][at] + within // copies
            offset = places["offset"][at] + within % copies * length
            columns = [*batch.columns[:at_rank], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise `docs` and pack all pieces: key, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than `capacity` are cut. A null text is the empty text (a piece of one id); repeated rows
    are packed each on its own; an empty table gives an empty result.
    """
    return place(stored(pieces(docs, path, key, text, capacity, end_id), "pieces"), (key, "piece", "ids_crc32"), capacity)
