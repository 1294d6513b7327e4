"""Vectorised text kernels: words, hashes and shingles of whole Arrow string columns.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  Everything works on slices of a few megabytes, cut between
documents; a text longer than that is a slice of its own, so memory is bounded by a slice or one text, not by a batch.
Null texts count as empty.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE = 2 << 20
#: Spans hashed together, and the most bytes of one that is hashed in blocks.
PIECE, LONG = 1 << 16, 64
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix_int(x: int) -> int:
    """64-bit finaliser of one Python integer; equals ``mix`` of the same value."""
    x &= _MASK
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & _MASK
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & _MASK
    return x ^ (x >> 33)


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    return np.array([mix_int(_GOLD * (seed * 100_003 + i + 1)) | 1 for i in range(n)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def once(name: str, make: Callable):
    """What ``make`` returns, made once in each process; functions shipped by value have no module of their own to keep it in."""
    home = sys.modules.setdefault("shelfspark_worker", types.ModuleType("shelfspark_worker")).__dict__
    if name not in home:
        home[name] = make()
    return home[name]


def latest(name: str, key, make: Callable, keep: int = 4):
    """As ``once``, for each of the ``keep`` keys used last."""
    home = once(name, dict)
    home[key] = home.pop(key) if key in home else make()
    while len(home) > keep:
        del home[next(iter(home))]
    return home[key]


def tables() -> dict:
    """Lookup tables."""
    return once("tables", _tables)


def _tables() -> dict:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    lower = np.arange(256)
    lower[65:91] += 32
    return {"space": space, "raw": np.arange(256).astype(np.uint8), "low": lower.astype(np.uint8), "tail": np.array([(1 << 8 * n) - 1 for n in range(9)], U64)}


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    freed()


def freed() -> None:
    """Give the system back what Arrow's pool has free: a worker process lives on with it, from task to task and query to query."""
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a text column: ``hash``, byte ``start`` and ``end``; words of row i are ``bound[i]:bound[i + 1]``."""

    def __init__(self, column: pa.Array, lower: bool = True, hashes: bool = True):
        t = tables()
        self.data, self.offsets = data, offsets = utf8(column)
        inside = ~t["space"][data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        first[offsets[:-1][full]] = inside[offsets[:-1][full]]
        last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bound = np.searchsorted(self.start, offsets)
        self.rows = len(column)
        self.hash = hash_spans(data, self.start, self.end, t["low" if lower else "raw"]) if hashes else None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bound)

    def row(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(self.rows), self.counts)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hash of each span, its bytes replaced as ``letters`` says: eight bytes at a time are mixed into it, so spans that differ in a
    regular way do not meet; spans of more than ``LONG`` bytes are digested as a whole."""
    t, size = tables(), end - start
    out = mix(size.astype(U64) * U64(_GOLD) + U64(1))
    for i in np.flatnonzero(size > LONG):
        whole = letters[data[start[i] : end[i]]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
    short = np.flatnonzero(size <= LONG)
    for at in range(0, len(short), PIECE):
        row = short[at : at + PIECE]
        for block in range(0, LONG, 8):
            row = row[size[row] > block]
            if not len(row):
                break
            first = start[row] + block
            inside = np.minimum(first[:, None] + np.arange(8), len(data) - 1)  # what lies behind a span is masked
            eight = letters[data[inside]].view("<u8").ravel() & t["tail"][np.minimum(size[row] - block, 8)]
            out[row] = mix((out[row] ^ eight) * U64(_GOLD) + U64(block + 1))
    return out


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bound): hashes of all runs of ``k`` words, row by row; a row of fewer words has its whole sequence as one."""
    h, bound = words.hash, words.bound
    n = np.diff(bound)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_bound = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(bound[:-1] - out_bound[:-1], many) + np.arange(out_bound[-1])
    factor = seeded(k + 1, 3)
    padded = np.concatenate([h, np.zeros(k, U64)])
    out = np.full(len(at), int(factor[k]) * k & _MASK, U64)
    for j in range(k):
        out = out * factor[j] + padded[at + j]
    out = mix(out)
    for i in np.flatnonzero((n > 0) & (n < k)):
        total = int(factor[k]) * int(n[i]) & _MASK
        for j, x in enumerate(h[bound[i] : bound[i + 1]]):
            total = (total * int(factor[j]) + int(x)) & _MASK
        out[out_bound[i]] = U64(mix_int(total ^ _GOLD))
    return out, out_bound


def distinct(values: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    parts = [np.unique(values[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def reduced(ufunc: np.ufunc, values: np.ndarray, bound: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each row's values; ``empty`` for a row without any."""
    out = np.full(len(bound) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(bound))
    if len(full):
        out[full] = ufunc.reduceat(values, bound[:-1][full])
    return out


def binary(values: np.ndarray, bound: np.ndarray) -> pa.Array:
    """Binary column of each row's values, little-endian."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(bound) - 1, [None, pa.py_buffer((bound * values.dtype.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())
