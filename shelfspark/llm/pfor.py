"""Patched frame of reference: blocks of unsigned integers, each against its own minimum and bit width.

A container holds whole blocks of ``block`` values (the last may be short).  Layout, little-endian:

    magic  4 bytes "PFR1"
    block  u32, values u64, blocks u32, exceptions u32
    index  per block: u64 byte offset into the packed part, u32 first exception, u32 minimum, u8 width
    packed per block: ceil(length * width / 8) bytes, value minus minimum, low ``width`` bits first
    exceptions: u32 position in the container each, then u32 high bits each

The width of a block covers the percentile asked for of its values; a larger value keeps its low bits in
place and its high bits in the exception list.  The index gives each block's start, so any range of values
is read without the blocks before it.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFR1"
INDEX = np.dtype([("offset", "<u8"), ("first", "<u4"), ("minimum", "<u4"), ("width", "u1")])
HEADER = "<4sIQII"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each value below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, block: int = 256, percentile: float = 95.0) -> bytes:
    """Container of ``values`` (uint32)."""
    values = np.asarray(values, np.uint32)
    n = len(values)
    blocks = -(-n // block)
    grid = np.zeros((blocks, block), np.uint32)
    grid.ravel()[:n] = values
    if n:
        grid.ravel()[n:] = values[-1]
    minimum = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = grid - minimum[:, None]
    bits = _bits(delta)
    rank = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    width = np.partition(bits, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.uint8)
    sizes = (np.minimum(block, n - np.arange(blocks) * block) * width.astype(np.int64) + 7) // 8
    index = np.zeros(blocks, INDEX)
    index["minimum"], index["width"] = minimum, width
    index["offset"] = np.concatenate([[0], np.cumsum(sizes)])[:-1] if blocks else 0
    outlier = bits > width[:, None]
    outlier.ravel()[n:] = False
    at = np.flatnonzero(outlier.ravel())
    index["first"] = np.searchsorted(at, np.arange(blocks) * block)
    high = (delta.ravel()[at].astype(np.uint64) >> np.repeat(width, block)[at].astype(np.uint64)).astype("<u4")
    packed = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        if w == 0:
            continue
        rows = np.flatnonzero(width == w)
        # one bit plane after another, then bits in value order
        planes = np.empty((len(rows), block, int(w)), np.uint8)
        for j in range(int(w)):
            planes[:, :, j] = (delta[rows] >> np.uint32(j)) & np.uint32(1)
        full = np.packbits(planes.reshape(len(rows), -1), axis=1, bitorder="little")
        whole = rows[sizes[rows] == full.shape[1]]
        spread = index["offset"][whole].astype(np.int64)[:, None] + np.arange(full.shape[1])
        packed[spread] = full[: len(whole)]
        if len(whole) < len(rows):  # only the last block of all can be short
            last = rows[-1]
            start = int(index["offset"][last])
            packed[start : start + int(sizes[last])] = full[-1, : int(sizes[last])]
    return b"".join([struct.pack(HEADER, MAGIC, block, n, blocks, len(at)), index.tobytes(), packed.tobytes(), at.astype("<u4").tobytes(), high.tobytes()])


def unpack(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values ``start:stop`` of a container; only the blocks that hold them are decoded."""
    magic, block, n, blocks, outliers = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a patched frame-of-reference container")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    index = np.frombuffer(data, INDEX, blocks, struct.calcsize(HEADER))
    tail = len(data) - 8 * outliers
    packed = np.frombuffer(data, np.uint8, tail - struct.calcsize(HEADER) - blocks * INDEX.itemsize, struct.calcsize(HEADER) + blocks * INDEX.itemsize)
    at, high = np.frombuffer(data, "<u4", outliers, tail), np.frombuffer(data, "<u4", outliers, tail + 4 * outliers)
    b0, b1 = start // block, -(-stop // block)
    out = np.empty((b1 - b0, block), np.uint32)
    widths = index["width"][b0:b1]
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w) + b0
        if w == 0:
            out[rows - b0] = index["minimum"][rows][:, None]
            continue
        size = -(-block * int(w) // 8)
        places = index["offset"][rows].astype(np.int64)[:, None] + np.arange(size)
        raw = packed[np.minimum(places, len(packed) - 1)]
        planes = np.unpackbits(raw, axis=1, count=block * int(w), bitorder="little").reshape(len(rows), block, int(w))
        value = np.zeros((len(rows), block), np.uint32)
        for j in range(int(w)):
            value |= planes[:, :, j].astype(np.uint32) << np.uint32(j)
        out[rows - b0] = value + index["minimum"][rows][:, None]
    e0 = int(index["first"][b0])
    e1 = int(index["first"][b1]) if b1 < blocks else outliers
    place = at[e0:e1].astype(np.int64) - b0 * block
    flat = out.ravel()
    flat[place] += (high[e0:e1].astype(np.uint64) << widths[place // block].astype(np.uint64)).astype(np.uint32)
    return flat[start - b0 * block : stop - b0 * block]
