"""A bitmap of bounded size that tells which 64-bit keys cannot be in a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64 MB.  Larger tables fill it more, so it lets more keys pass, but never stops one that is there.
MAX_BITS = 1 << 29

#: Each probe reads other bits of the key.
SHIFT = 11


def bitmap_of(keys: DataFrame, column: str, rows: int, per_row: int = 16, probes: int = 1, max_bits: int = MAX_BITS):
    """Bits of all ``column`` values, as 64-bit words; ``per_row`` for each of ``rows``, or ``max_bits``.

    Keys that are hashes may take up to four probes; ids in sequence take one.
    """
    bits = min(max_bits, 1 << max(10, (per_row * max(1, rows) - 1).bit_length()))
    places = [F.shiftrightunsigned(column, SHIFT * k).bitwiseAND(F.lit(bits - 1)) for k in range(probes)]
    at = keys.select(F.explode(F.array(*places)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(bit).alias("b"))
    got = words.toPandas()
    out = np.zeros(bits // 64, dtype="uint64")
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype("int64").view("uint64")
    return out


def may_hold(bitmap, keys, probes: int = 1):
    """Whether each key (64-bit, two's complement) may be in the table."""
    keys = keys.view("uint64")
    passed = np.arange(len(keys))
    for k in range(probes):
        at = (keys[passed] >> np.uint64(SHIFT * k)) & np.uint64(len(bitmap) * 64 - 1)
        word = bitmap[(at >> np.uint64(6)).astype("int64")]
        passed = passed[(word >> (at & np.uint64(63))) & np.uint64(1) != 0]
    out = np.zeros(len(keys), dtype=bool)
    out[passed] = True
    return out
