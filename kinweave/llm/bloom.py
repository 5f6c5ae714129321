"""A Bloom filter of 128-bit keys, built by a grouped aggregation and of a bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bits of a filter (8 MB): beyond its capacity it passes more and more, and what is exact follows it.
MOST_BITS = 26
PROBES = 4


def build(keys: DataFrame, rows: int, high: str = "h1", low: str = "h2") -> np.ndarray:
    """The filter's 64-bit words; ``rows`` is the number of keys, for the size. Only words with a bit set travel."""
    bits = min(MOST_BITS, max(16, int(rows * 10).bit_length()))
    mask = F.lit((1 << bits) - 1)
    places = F.array(*(F.shiftrightunsigned(c, s).bitwiseAND(mask) for c in (high, low) for s in (0, 32)))
    at = keys.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    found = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return words


def passes(words: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which of the 64-bit pairs the filter may hold."""
    mask = np.uint64(len(words) * 64 - 1)
    ok = np.ones(len(high), dtype=bool)
    for c in (high, low):
        for s in (0, 32):
            p = (c >> np.uint64(s)) & mask
            ok &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok
