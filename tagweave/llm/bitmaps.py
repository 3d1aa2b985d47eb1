"""Bitmaps of bounded size that tell tasks which hashes may be in a set.

A bitmap only spares work: what it lets through is joined or counted exactly afterwards. So its size has
a fixed upper bound whatever the size of the set, and a set too large for it costs more rows but changes none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits per member, and the least and most bits of a bitmap (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 27
#: Parts of a hash, by their lowest bit, that say which bits are set.
SHIFTS = (0, 16, 32, 37)


def bitmap(hashes: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """The bitmap of the long column ``hash``: a bit per hash and shift, in 64-bit words."""
    members = hashes.count()
    bits = LEAST_BITS
    while bits < min(members * BITS_EACH, most_bits):
        bits *= 2
    spots = [F.shiftrightunsigned("hash", shift).bitwiseAND(bits - 1) for shift in SHIFTS]
    spots = hashes.select(F.explode(F.array(*spots)).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")).alias("bits")
    ).toArrow()
    found = np.zeros(bits // 64, np.uint64)
    found[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return found


def may_hold(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each of the unsigned 64-bit hashes may be in the set; never false for a member."""
    mask = np.uint64(len(found) * 64 - 1)
    held = np.ones(len(hashes), bool)
    for shift in SHIFTS:
        spot = (hashes >> np.uint64(shift)) & mask
        held &= ((found[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)).astype(bool)
    return held
