"""Quality classifier: FTRL logistic regression on hashed word n-grams.

Tokens are runs of letters and digits, or of signs.  Features are one- and two-token n-grams of the tokens
themselves and one- to three-token n-grams of their shapes (case and kind of sign), and a mark for each
three-token n-gram that the text had before.  A feature weighs the root of its share of the text, so long and
short texts compare.  Empty and null texts have the bias alone.  Without labelled rows every
score is 0.27.  Rows that repeat a ``doc_id`` are scored each; a null ``doc_id`` is never learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, linear


@dataclass(frozen=True)
class Quality:
    """``rows``: the most labelled rows that are learnt from; ``features``: the most features that these have together."""

    rows: int = 8000
    features: int = 40_000_000
    threshold: float = 0.3
    ftrl: linear.Ftrl = field(default_factory=lambda: linear.Ftrl(bits=18, alpha=0.6, beta=0.05, l1=0.05, epochs=4))


def _shapes(runs: linear.Runs) -> np.ndarray:
    """A small code for each token: its kind, first character's class, and whether all is upper case."""
    data = runs.data
    upper = (data >= 65) & (data <= 90)
    low = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    if not len(runs.start):
        return np.zeros(0, np.uint64)
    total = np.concatenate([[0], np.cumsum(upper)])
    lows = np.concatenate([[0], np.cumsum(low)])
    digits = np.concatenate([[0], np.cumsum(digit)])
    n = runs.end - runs.start
    ups = total[runs.end] - total[runs.start]
    code = np.where(runs.kind == 2, 64 + data[runs.start] + 256 * np.minimum(n, 4), upper[runs.start] * 1 + ((ups > 1) & (lows[runs.end] == lows[runs.start])) * 2 + (digits[runs.end] > digits[runs.start]) * 4)
    return kernels.mix(code.astype(np.uint64) + np.uint64(977))


def extractor(bits: int):
    def extract(column: pa.Array):
        runs = linear.Runs(column, lower=False, signs=True)
        row, shape = runs.row(), _shapes(runs)
        views = [linear.ngrams(runs.hash, row, n, n) for n in (1, 2)] + [linear.ngrams(shape, row, n, 10 + n) for n in (1, 2, 3)]
        three, at = linear.ngrams(runs.hash, row, 3, 3)
        if len(three):
            order = np.lexsort((three, at))
            again = np.flatnonzero((three[order][1:] == three[order][:-1]) & (at[order][1:] == at[order][:-1])) + 1
            views.append((np.full(len(again), kernels.mix_int(4242), np.uint64), at[order][again]))
        h, where = np.concatenate([v[0] for v in views]), np.concatenate([v[1] for v in views])
        bound, index, count = linear.counted(h, where, len(column), bits)
        value = np.sqrt(count / np.maximum(np.repeat(np.diff(runs.bound), np.diff(bound)), 1))
        return (bound, index, value), []

    return extract


def train(docs: DataFrame, labels: DataFrame, how: Quality = Quality()) -> np.ndarray:
    return linear.fit(linear.training_rows(docs, labels, "quality", extractor(how.ftrl.bits), how.rows, how.features), how.ftrl)


def scores(docs: DataFrame, labels: DataFrame, how: Quality = Quality()) -> DataFrame:
    """doc_id, held_out, score, predicted, row for row of ``docs``."""
    weights = train(docs, labels, how)
    out = linear.scored(docs.select("doc_id", "text"), weights, extractor(how.ftrl.bits))
    return out.select("doc_id", linear.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= how.threshold).cast("int").alias("predicted"))
