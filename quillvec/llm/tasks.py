"""Row code that runs inside Spark's Python tasks. It travels by value, so workers need no installed package."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle

WORDS_KEPT = 150_000


class WordHashes(dict):
    """64-bit hashes of byte words, remembered for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as none."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
