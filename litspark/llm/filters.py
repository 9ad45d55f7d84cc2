"""Bloom filters of 64-bit keys, built by the tasks and looked up in numpy.

A filter is a number of slices of 64 KB, and each slice is filled by one task from the keys that fall into it, so the
driver only puts the slices together: what it holds and sends on is the filter itself, whose size is bounded by
``slices_of``.  False hits must be harmless: a filter only spares work that an exact comparison would do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Filter:
    """A Bloom filter in slices of 64 KB; a key lies in one slice."""

    BITS = 19

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def places(key: np.ndarray) -> list[np.ndarray]:
        """Where in its slice a key sets its four bits."""
        m = key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        m ^= m >> np.uint64(32)
        mask = np.uint64((1 << Filter.BITS) - 1)
        a, b = m & mask, m >> np.uint64(Filter.BITS) & mask | np.uint64(1)
        return [((a + np.uint64(j) * b) & mask).astype(np.int64) for j in range(4)]

    @staticmethod
    def of(keys: DataFrame, slices: int) -> Filter:
        """The filter of a column ``key`` (long); slices is a power of two."""

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            bits = np.zeros(1 << Filter.BITS, dtype=bool)
            for at in Filter.places(pdf["key"].to_numpy()):
                bits[at] = True
            return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "b": [np.packbits(bits, bitorder="little").tobytes()]})

        out = np.zeros(slices << (Filter.BITS - 3), dtype=np.uint8)
        rows = keys.select("key", F.pmod("key", F.lit(slices)).cast("int").alias("slice")).groupBy("slice").applyInPandas(fill, "slice int, b binary")
        for r in rows.toLocalIterator():
            out[r.slice << (Filter.BITS - 3) : (r.slice + 1) << (Filter.BITS - 3)] = np.frombuffer(r.b, dtype=np.uint8)
        return Filter(out)

    def hits(self, key: np.ndarray) -> np.ndarray:
        """Indices of the keys that may be in the filter."""
        slices = len(self.words) >> (self.BITS - 3)
        left = np.arange(len(key))
        base = (key & (slices - 1)) << (self.BITS - 3)
        for at in self.places(key):
            at = at[left]
            left = left[(self.words[base[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
        return left


def slices_of(n: int, per_key: int = 16, most: int = 1 << 11) -> int:
    """Slices of a filter of n keys, a power of two."""
    return min(most, 1 << max(0, (max(1, n) * per_key - 1).bit_length() - Filter.BITS))
