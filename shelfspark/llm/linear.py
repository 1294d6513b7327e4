"""Logistic regression on hashed word n-grams, trained with follow-the-regularised-leader (FTRL-proximal) updates.

A row's features are sparse: an index array below ``2 ** bits`` and a value array.  Training takes a bounded
number of labelled rows, the ones whose ``doc_id`` hashes lowest, whatever the table's size or order; scoring is
a sparse dot product over every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kernels, store

#: Bytes of text whose features are made at once; they take some fifty times as much memory.
SLICE = 1 << 20
#: Kinds of bytes: 0 white space, 1 letters, digits and all of non-ASCII, 2 other visible characters.
KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 1


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    alpha: float = 0.5
    beta: float = 0.1
    l1: float = 0.02
    l2: float = 1e-4
    epochs: int = 3
    positive: float = 1.0
    swap_penalty: float = 0.0
    seed: int = 5


class Runs:
    """Tokens of a text column: runs of one kind of character, words apart from signs, with bounds by row."""

    def __init__(self, column: pa.Array, lower: bool, signs: bool):
        self.data, offsets = kernels.utf8(column)
        self.rows = len(column)
        kind = KIND[self.data]
        edge = np.ones(len(kind), bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        at = np.flatnonzero(edge)
        end = np.append(at[1:], len(kind))[: len(at)]
        keep = kind[at] > 0 if signs else kind[at] == 1
        self.start, self.end, self.kind = at[keep], end[keep], kind[at][keep]
        self.bound = np.searchsorted(self.start, offsets)
        self.hash = kernels.hash_spans(self.data, self.start, self.end, kernels.tables()["low" if lower else "raw"])

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bound))


def ngrams(h: np.ndarray, row: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the runs of ``n`` tokens that lie in one row."""
    if len(h) < n:
        return h[:0], row[:0]
    factor, m = kernels.seeded(n + 1, 100 + salt), len(h) - n + 1
    out = np.full(m, factor[n], np.uint64)
    for j in range(n):
        out = out * factor[j] + h[j : m + j]
    inside = row[:m] == row[n - 1 :]
    return kernels.mix(out[inside]), row[:m][inside]


def counted(h: np.ndarray, row: np.ndarray, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bound, index, count): each row's distinct hashed features; index 0 is left for the bias."""
    index = h >> np.uint64(64 - bits)
    key, count = np.unique((row.astype(np.uint64) << np.uint64(bits)) | np.maximum(index, np.uint64(1)), return_counts=True)
    return np.searchsorted(key >> np.uint64(bits), np.arange(rows + 1, dtype=np.uint64)), (key & np.uint64((1 << bits) - 1)).astype(np.int32), count


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """crc32 of the id as text leaves ``remainder``; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple], how: Ftrl) -> np.ndarray:
    """Weights from rows (index, value, others, label); ``others``: the same for each counterfactual text, the last of them the one
    that names no group.  In each epoch a row meets one of the former, drawn anew, and the latter: the squared change of the
    score is penalised, and both are learnt with the row's own label.  Without rows every score is that of a bias of -1."""
    z, n, w = np.zeros(1 << how.bits), np.zeros(1 << how.bits), np.zeros(1 << how.bits)
    if not rows:
        w[0] = -1
    l1 = np.full(1 << how.bits, how.l1)
    l1[0] = 0
    rng = np.random.default_rng(how.seed)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0, -(zi - np.sign(zi) * l1[i]) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2))

    def step(i, g, wi):
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha
        z[i] += g - sigma * wi
        n[i] += g * g

    def pull(score, label):
        return (sigmoid(score) - label) * (how.positive if label else 1)

    for _ in range(how.epochs):
        for r in rng.permutation(len(rows)):
            index, value, others, label = rows[r]
            wi = weights(index)
            score = wi @ value
            if not others or not how.swap_penalty:
                step(index, pull(score, label) * value, wi)
                continue
            met = [others[-1]] + ([others[rng.integers(len(others) - 1)]] if len(others) > 1 else [])
            every = np.unique(np.concatenate([index, *(i for i, _ in met)]))
            g, own = np.zeros(len(every)), pull(score, label)
            for i, x in met:
                other = weights(i) @ x
                gap = 2 * how.swap_penalty * (score - other)
                own += gap
                g[np.searchsorted(every, i)] += (pull(other, label) - gap) * x
            g[np.searchsorted(every, index)] += own * value
            step(every, g, weights(every))
    every = np.flatnonzero(n)
    w[every] = weights(every)
    return w.astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, extract: Callable, rows: int, features: int, of: int = 5) -> list[tuple]:
    """Features of a bounded sample: of the labelled ids outside the held-out part, at most ``rows`` whose hash is lowest, as far
    as their features add up to ``features``.  An id that repeats counts once for each label, with the text whose hash is lowest."""
    picked = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label"))
        .filter(F.col("__label").isNotNull() & F.col("__id").isNotNull() & ~held_out(F.col("__id"), of, 0))
        .distinct()
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    sample = sample.groupBy("__id", "__label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = sample.select(F.xxhash64("__id", "__label").alias("order"), F.col("__label").alias("label"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text", SLICE):
                (bound, index, value), others = extract(part.column("text"))
                cut = lambda b, x, i: x[b[i] : b[i + 1]].tobytes()
                i2, x2 = [], []
                for i in range(part.num_rows):
                    own = [(cut(b, j.astype(np.int32), i), cut(b, v.astype(np.float32), i)) for b, j, v, named in others if named[i]]
                    i2.append([o[0] for o in own])
                    x2.append([o[1] for o in own])
                yield pa.record_batch(
                    {
                        "order": part.column("order"),
                        "label": part.column("label"),
                        "n": pa.array(np.diff(bound) + [sum(len(o) // 4 for o in row) for row in i2], pa.int64()),
                        "i": kernels.binary(index.astype(np.int32), bound),
                        "x": kernels.binary(value.astype(np.float32), bound),
                        "i2": pa.array(i2, pa.list_(pa.binary())),
                        "x2": pa.array(x2, pa.list_(pa.binary())),
                    }
                )

    made = store.stored(sample.mapInArrow(run, "order long, label int, n long, i binary, x binary, i2 array<binary>, x2 array<binary>"), "features")
    sizes = sorted(made.select("order", "n").collect())
    whole = int(np.searchsorted(np.cumsum([s.n for s in sizes]), features, "right"))
    out = []
    if whole:
        view = lambda i, x: (np.append(np.int32(0), np.frombuffer(i, np.int32)), np.append(np.float32(1), np.frombuffer(x, np.float32)))
        for r in made.filter(F.col("order") <= sizes[whole - 1].order).toLocalIterator():
            out.append((r.order, *view(r.i, r.x), [view(*o) for o in zip(r.i2, r.x2, strict=True)], r.label))
    store.dropped(made)
    out.sort(key=lambda r: r[0])  # the same order whatever task came first
    return [r[1:] for r in out]


def scored(docs: DataFrame, weights: np.ndarray, extract: Callable, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``name``, computed from ``text`` alone; other columns pass unseen."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text", SLICE):
                (bound, index, value), _ = extract(part.column("text"))
                dot = kernels.reduced(np.add, weights[index] * value, bound, 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sigmoid(dot + weights[0]))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)
