"""CRC-32C of many byte strings at once, and its masked form.

A checksum without start value is linear, so bytes are looked up by their distance from the end of a
block of ``BLOCK`` bytes and combined by XOR; the checksums of neighbouring blocks join in pairs, the
left one moved on by the bytes to its right.  Zero bytes in front change nothing, so every string is
filled up to whole blocks at its front.
"""

from __future__ import annotations

import functools

import numpy as np

#: Reflected Castagnoli polynomial, and the constant of the mask (fixed values).
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

BLOCK = 64


@functools.cache
def _byte_table():
    table = np.arange(256, dtype="uint32")
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


@functools.cache
def _by_distance():
    """What a byte adds to the checksum, by the number of bytes after it in its block."""
    rows = [_byte_table()]
    while len(rows) < BLOCK:
        rows.append(_step(rows[-1]))
    return np.stack(rows)


def _step(c):
    return (c >> np.uint32(8)) ^ _byte_table()[c & np.uint32(255)]


@functools.cache
def _move(level: int):
    """Four tables that move a checksum on by ``BLOCK << level`` zero bytes."""
    if level:
        half = level - 1
        return np.stack([_moved(row, half) for row in _move(half)])
    values = np.arange(256, dtype="uint32")[None, :] << np.array([[0], [8], [16], [24]], dtype="uint32")
    for _ in range(BLOCK):
        values = _step(values)
    return values


def _moved(c, level: int):
    t = _move(level)
    low = np.uint32(255)
    return (
        t[0][c & low]
        ^ t[1][(c >> np.uint32(8)) & low]
        ^ t[2][(c >> np.uint32(16)) & low]
        ^ t[3][c >> np.uint32(24)]
    )


def crc32c(data, starts, ends):
    """CRC-32C of ``data[start:end]`` for every pair; each string has four bytes or more."""
    starts, ends = np.asarray(starts, dtype="int64"), np.asarray(ends, dtype="int64")
    if not len(starts):
        return np.zeros(0, dtype="uint32")
    if (ends - starts).min() < 4:
        raise ValueError("a string of fewer than four bytes")
    blocks = -(-(ends - starts) // BLOCK)
    last = np.cumsum(blocks)
    padded = np.zeros(int(last[-1]) * BLOCK, dtype="uint8")
    length = ends - starts
    shift = last * BLOCK - ends
    at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    padded[at + np.repeat(shift, length)] = data[at]
    # the start value of all ones, put into the first four bytes
    head = (starts + shift)[:, None] + np.arange(4)
    padded[head] ^= 0xFF
    table = _by_distance()
    lanes = padded.reshape(-1, BLOCK)
    c = np.zeros(len(lanes), dtype="uint32")
    for k in range(BLOCK):
        c ^= table[BLOCK - 1 - k][lanes[:, k]]
    level = 0
    while blocks.max() > 1:
        pairs = (blocks + 1) // 2
        end, new_end = np.cumsum(blocks), np.cumsum(pairs)
        back = np.repeat(new_end, pairs) - 1 - np.arange(int(new_end[-1]))  # pairs after this one
        right = np.repeat(end, pairs) - 1 - 2 * back
        has_left = right > np.repeat(end - blocks, pairs)
        left = np.where(has_left, c[np.maximum(right - 1, 0)], np.uint32(0))
        c = _moved(left, level) ^ c[right]
        blocks, level = pairs, level + 1
    return ~c


def masked(c):
    """Rotated and shifted, so that a checksum of data that holds checksums stays sound."""
    c = np.asarray(c, dtype="uint32")
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(MASK_DELTA)
