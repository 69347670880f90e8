"""Word shingles as 64-bit hashes: words are hashed in the JVM, windows of them in numpy over whole batches."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words in order; words are cut at white space, a null text has none."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


@cache
def factors(k: int) -> np.ndarray:
    return np.random.default_rng(k).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the start of each row's, with the end; null rows are empty."""
    if column.null_count:
        column = pa.array(column.to_pylist(), column.type)
    offsets = np.asarray(column.offsets, np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.uint64), offsets - offsets[0]


def windows(words: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of the ``k`` words from each place, or from the places ``at``; fewer than k words give one hash of them all."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    f = factors(k)
    m = max(n - k + 1, 1)
    h = np.full(m if at is None else len(at), np.uint64(min(n, k)), np.uint64)
    for j in range(min(n, k)):
        h += (words[j:j + m] if at is None else words[at + j]) * f[j]
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h
