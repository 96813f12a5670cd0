"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

A BPE encoding is the only token sequence whose neighbours are all compatible, so the encoding of a prefix is known
from its last token: the one vocabulary suffix of the prefix that may follow the last token of what stands before it.
The distinct words of a slice of documents are put in order, which lays their trie out depth first: words that share a
prefix are neighbours, the path of the word before is kept as a stack of last tokens, and only the nodes below the
shared prefix are computed. Every shared prefix is thus encoded once.

A document is a row of its own: no shuffle, no state that grows with the input (the word cache is bounded and never
decides about results). A null text is encoded as the empty text. Special tokens of the vocabulary file are cut out of
a text first, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

# White space as the vocabulary's pattern counts it, and that pattern.
WHITE = "\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points of text handled at a time, and units of text remembered between slices.
SLICE_CHARS = 2_000_000
CACHE_UNITS = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that a vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        letters = _byte_letters()
        names = whole["model"]["vocab"]
        self.special = {token["content"]: token["id"] for token in whole["added_tokens"]}
        self.ids = {bytes(letters[c] for c in name): i for name, i in names.items() if name not in self.special}
        self.text = {i: word for word, i in self.ids.items()} | {i: word.encode() for word, i in self.special.items()}
        self.rank = dict.fromkeys(self.text, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(whole["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, made = (names[left], names[right]), names[left + right]
            self.merges[pair] = rank
            self.rank.setdefault(made, -1)
            if self.rank[made] < 0:
                self.rank[made], self.halves[made] = rank, pair
        self.size = {i: len(word) for word, i in self.ids.items()}
        self.suffixes = ahocorasick.Automaton()  # finds the vocabulary's tokens that end at each byte of a word
        for word, i in self.ids.items():
            self.suffixes.add_word(word.decode("latin-1"), i)
        self.suffixes.make_automaton()
        self._allowed: dict[int, bool] = {}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging text of `left` and `right` in order of rank leaves these two tokens.

        The tokens' own merges are undone from the last to the first; at no time may the pieces that then meet at
        the border have a merge that comes before the merges which take these pieces up.
        """
        rank, halves, merges = self.rank, self.halves, self.merges
        taken_left = taken_right = 1 << 60
        while True:
            merge = merges.get((left, right))
            if merge is not None and merge < taken_left and merge <= taken_right:
                return False
            made_left, made_right = rank[left], rank[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                taken_left, left = made_left, halves[left][1]
            else:
                taken_right, right = made_right, halves[right][0]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Encodings of distinct words (a letter for each byte), by one depth-first walk over their trie."""
        suffixes, size, allowed, may_follow = self.suffixes.iter, self.size, self._allowed, self.may_follow
        if len(allowed) > 1_000_000:
            allowed.clear()
        out: dict[str, list[int]] = {}
        before, path = "", [-1]  # path[d]: last token of the first d bytes
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            done = shared
            for end, token in suffixes(word):
                if end < done:
                    continue
                last = path[end + 1 - size[token]]
                if last >= 0:
                    fits = allowed.get(pair := last << 32 | token)
                    if fits is None:
                        fits = allowed[pair] = may_follow(last, token)
                    if not fits:
                        continue
                path.append(token)
                done += 1
            tokens, end = [], len(word)
            while end:
                tokens.append(path[end])
                end -= size[path[end]]
            tokens.reverse()
            out[word] = tokens
            before = word
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts; texts are cut into units (white space and what follows it) that are encoded independently."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self._units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self._words = regex.compile(PATTERN).findall
        self._known: dict[str, bytes] = {}
        self._known_words: dict[str, list[int]] = {}

    def _learn(self, units: set[str]) -> None:
        parts, known = {}, self._known_words
        for unit in units:
            if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
                words = [unit]
            else:
                words = self._words(unit)
            parts[unit] = [word if word.isascii() else word.encode().decode("latin-1") for word in words]
        known.update(self.vocabulary.encode_words(list({word for words in parts.values() for word in words}.difference(known))))
        for unit, words in parts.items():
            self._known[unit] = array("I", known[words[0]] if len(words) == 1 else [t for word in words for t in known[word]]).tobytes()

    def encode(self, texts: list[str]) -> list[array]:
        """Token ids of each text."""
        special, split = self.vocabulary.special, self.vocabulary._split
        if len(self._known) > CACHE_UNITS:
            self._known.clear()
            self._known_words.clear()
        known, new = self._known, set()
        parts: list[list[tuple[list[str], list[bytes | None]]]] = []
        for text in texts:
            marked = split is not None and any(word in text for word in special)
            parts.append([])
            for piece in split(text) if marked else (text,):
                if marked and piece in special:
                    parts[-1].append(([], [array("I", [special[piece]]).tobytes()]))
                    continue
                units = self._units(piece)
                ids = [*map(known.get, units)]
                if None in ids:
                    new.update(unit for unit, own in zip(units, ids) if own is None)
                    parts[-1].append((units, ids))
                else:
                    parts[-1].append(([], [b"".join(ids)]))
        self._learn(new)
        out = []
        for own in parts:
            whole = b"".join([b"".join([known[units[i]] if x is None else x for i, x in enumerate(ids)]) for units, ids in own])
            out.append(array("I", whole))
        return out

    def decode(self, ids: array) -> str:
        """The text of token ids; bytes that are no text become replacement characters."""
        return b"".join(map(self.vocabulary.text.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in runs of bounded length; null is the empty text."""
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size >= SLICE_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """`keep` columns of `docs` (all but the text, if not given) and the token ids of the text."""
    kept = list(keep) if keep is not None else [c for c in docs.columns if c != text]
    picked = docs.select(*kept, docs[text].alias("__text"))
    schema = picked.drop("__text").schema.add(into, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            done = 0
            for texts in slices(batch.column(len(kept)).to_pylist()):
                ids = [pa.array(memoryview(x).cast("B").cast("i") if len(x) else [], pa.int32()) for x in own.encode(texts)]
                column = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, len(texts)) for i in range(len(kept))), column], names=schema.names)
                done += len(texts)

    return picked.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """All columns of `encoded` but the ids, and the text that the ids stand for; null ids give null."""
    kept = [c for c in encoded.columns if c != ids]
    picked = encoded.select(*kept, encoded[ids].alias("__ids"))
    schema = picked.drop("__ids").schema.add(into, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], names=schema.names)

    return picked.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of tokens, digest of the ids and digest of the text decoded from these ids."""
    schema = docs.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        decimal = {i: str(i) for i in own.vocabulary.text}
        for batch in batches:
            counts, digests, decoded = [], [], []
            for texts in slices(batch.column(1).to_pylist()):
                for ids in own.encode(texts):
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
