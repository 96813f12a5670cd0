"""Words of a text as bytes, and hashes of windows of words."""

from __future__ import annotations

import numpy as np

SEED = 13
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            self._up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _ODD)]), dtype=np.uint64)
            self._down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse)]), dtype=np.uint64)
        return self._up, self._down


_powers = _Powers()


def words_of(text: str | None) -> bytes:
    """The words of a text ([^\\x20\\x09-\\x0D]+) in UTF-8, joined by one blank."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


def mixed(x: np.ndarray) -> np.ndarray:
    """All bits of the input in all bits of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of windows of consecutive words; the sum over all bytes is made once."""

    def __init__(self, words: bytes) -> None:
        data = np.frombuffer(words, np.uint8)
        blanks = np.flatnonzero(data == 32)
        self.count = len(blanks) + 1 if len(data) else 0
        self._starts = np.concatenate([[0], blanks + 1])
        self._ends = np.concatenate([blanks, [len(data)]])
        up, self._down = _powers.of(len(data) + 1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[: len(data)], dtype=np.uint64)])

    def hashes(self, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the windows of `width` words that start at the word numbers `at` (all, if not given)."""
        n = max(0, self.count - width + 1)
        at = np.arange(n) if at is None else at[at < n]
        starts = self._starts[at]
        return mixed((self._sums[self._ends[at + width - 1]] - self._sums[starts]) * self._down[starts])
