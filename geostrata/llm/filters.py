"""Bit filters over 64-bit hashes, sized by their number: false positives only, so an exact check follows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a hash, least and most bits of a filter (most: 32 MB). Beyond that more hashes pass, at the cost of time only.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 28


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """The filter of a column h of 64-bit hashes, as words of 64 bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * hashes.count()).bit_length()))
    low = hashes.select(F.col("h").bitwiseAND((1 << bits) - 1).alias("h"))
    words = low.groupBy(F.shiftright("h", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for w, v in words.toLocalIterator():
        out[w] = v
    return out.view(np.uint64)


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (64-bit integers) may be in the filter."""
    h = h & (64 * len(words) - 1)
    return ((words[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
