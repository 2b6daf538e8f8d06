"""Hashes of words and of runs of words as numpy arrays. They depend on the words alone, never on the process."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

#: An odd base and its inverse modulo 2**64, for polynomial hashes of runs.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CACHE_WORDS = 120_000


class _Words(dict):
    """Hashes by word; bounded."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < CACHE_WORDS and len(word) < 64:
            self[word] = value
        return value


@cache
def _table(seed: int) -> _Words:
    return _Words(seed)


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(_table(seed).__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches the high bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """`[^\\x20\\x09-\\x0D]+` in UTF-8: bytes.split() splits at exactly these."""
    return (text or "").encode("utf-8", "surrogatepass").split()


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    if n > 1:
        up[1:], down[1:] = BASE, INVERSE
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each position on (rolling: two prefix sums apart)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = 1 << int(len(hashes) - 1).bit_length()
    up, down = _powers(max(size, 1))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[:n])
