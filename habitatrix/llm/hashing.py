"""64-bit hashes of byte spans, words and word shingles, for whole arrays of texts at a time.

A span's hash is a polynomial over random values of its bytes, read off running sums, so any
number of spans costs one pass over the bytes.  Values are the same on every machine.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def mix(h):
    """Finalise: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype="uint64") * np.uint64(_BASE))
_FOLD = np.arange(256, dtype="uint8")
_FOLD[65:91] += 32
_LOWER_BYTE = _BYTE[_FOLD]

#: Separators of words: blank and the controls from tab to carriage return.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: Word characters where punctuation is ignored: ASCII letters and digits, and all other scripts.
WORDLIKE = np.zeros(256, dtype=bool)
WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(n: int, inverse: bool = False):
    """The first ``n`` powers of the base, or of its inverse."""
    kind = "inverse" if inverse else "base"
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        have = np.full(max(n, 1 << 16), base, dtype="uint64")
        have[0] = 1
        _powers[kind] = have = np.cumprod(have, dtype="uint64")
    return have[:n]


class Spans:
    """Hashes of any spans of one byte array."""

    def __init__(self, data, lower: bool = False):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype="uint64")
        np.cumsum((_LOWER_BYTE if lower else _BYTE)[data] * powers(n), out=self.sums[1:])

    def hash(self, starts, ends):
        h = (self.sums[ends] - self.sums[starts]) * powers(len(self.sums), inverse=True)[starts]
        return mix(h ^ ((ends - starts).astype("uint64") * np.uint64(_BASE)))

    def fixed(self, width: int):
        """Hash of every span of ``width`` bytes, by start."""
        n = len(self.sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, dtype="uint64")
        return mix((self.sums[width:] - self.sums[:n]) * powers(n, inverse=True))


def word_spans(data, bounds, member):
    """Starts and ends of the maximal runs of ``member`` bytes that do not cross ``bounds``."""
    inside = member[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def words(data, bounds, member=None):
    """Hash of every word, lower-cased in A-Z, and the index of each text's first word."""
    starts, ends = word_spans(data, bounds, ~SEPARATOR if member is None else member)
    return Spans(data, lower=True).hash(starts, ends), np.searchsorted(starts, bounds)


_SLOTS = mix(np.arange(1, 65, dtype="uint64") * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def runs(hashes, offsets):
    """Order-sensitive hash of ``hashes[i + o]`` over ``offsets``, for every i where all exist."""
    n = max(0, len(hashes) - max(offsets))
    out = np.zeros(n, dtype="uint64")
    for k, o in enumerate(offsets):
        out += mix(hashes[o : o + n] * _SLOTS[k])
    return mix(out)
