"""Hashed character n-grams of many texts at once, and bounded samples of labelled rows."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.session import lookup

#: Hashed n-gram bins.
BITS = 16

#: Texts in one presence matrix (each takes one byte for every bin).
ROWS = 512

_C = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype="uint32")


def codepoints(texts: list[str], lower: bool):
    """Code points of all texts with a 0 after each, and the row of each position."""
    joined = "\0".join([t.replace("\0", "�") for t in texts]) + "\0"
    if lower:
        joined = joined.lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="uint32")
    ends = points == 0
    rows = np.cumsum(ends, dtype="int64") - ends
    return points, rows


@cache
def letters():
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool)


def grams(points, order: int, bits: int = BITS):
    """Start and bin of every n-gram inside one text."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
    h = np.full(n, order, dtype="uint32")
    inside = np.ones(n, dtype=bool)
    for k in range(order):
        part = points[k : k + n]
        inside &= part != 0
        h = (h ^ part) * _C[k]
        h ^= h >> np.uint32(15)
    h *= _C[3]
    at = np.flatnonzero(inside)
    return at, (h[at] >> np.uint32(32 - bits)).astype("int64")


def presence(points, rows, n_rows: int, orders, bits: int = BITS):
    """Which bins each text has, as a matrix of truth values."""
    has = np.zeros((n_rows, 1 << bits), dtype=bool)
    for order in orders:
        at, bins = grams(points, order, bits)
        has[rows[at], bins] = True
    return has


def bounded_sample(rows: DataFrame, label: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """About ``per_label`` rows of each label, by a hash of ``key``, with ``weight`` rows for each."""
    share = F.least(F.lit(1.0), F.lit(float(per_label)) / F.count(F.lit(1)))
    rates = lookup(rows.groupBy(F.col(label).alias("_of")).agg(share.alias("_rate")))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rated = rows.join(rates, F.col(label).eqNullSafe(F.col("_of"))).where(draw < F.col("_rate"))
    return rated.withColumn("weight", 1.0 / F.col("_rate")).drop("_of", "_rate")
