"""Toxicity classifier with counterfactual regularisation.

FTRL logistic regression on the presence of hashed words and word beginnings, lower-cased.  Where a labelled text
names a group of people, its counterfactuals are made too: the terms swapped for each other one of their kind in turn,
and left out.  In each epoch the text meets one swap, drawn anew, and the text that names no group.  The squared change
of the score is penalised and both are learnt with the text's own label, so neither which group is named nor that one is
named raises or lowers a score by itself.
Empty and null texts have the bias alone.  Without labelled rows every score is 0.27 and ``clean`` keeps all.  Rows that repeat a ``doc_id`` are scored each; a null ``doc_id`` is
never learnt from.  Extra columns are ignored by ``scores`` and kept by ``clean``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, linear

#: Terms that name groups of people, by kind; a term is swapped for the others of its kind.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight"),
    ("lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("immigrant", "refugee", "foreigner", "native", "local"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Toxicity:
    """``rows``: the most labelled rows that are learnt from; ``features``: the most features that these have together."""

    rows: int = 8000
    features: int = 40_000_000
    threshold: float = 0.5
    identities: tuple[tuple[str, ...], ...] = IDENTITIES
    ftrl: linear.Ftrl = field(default_factory=lambda: linear.Ftrl(bits=20, alpha=1.0, beta=1.0, l1=10.0, epochs=3, positive=2.0, swap_penalty=2.0))


def swaps(identities: tuple[tuple[str, ...], ...]) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """(hashes of the terms in ascending order, size of each one's kind, for each shift the views of the term so far behind it in its kind)."""
    most = max(map(len, identities))
    terms = [(kind, i) for kind in identities for i in range(len(kind))]
    runs = linear.Runs(pa.array([kind[(i + by) % len(kind)] for by in range(most) for kind, i in terms]), lower=True, signs=False)
    seen = [v.reshape(most, len(terms)) for v in views(runs)]
    one, at = np.unique(seen[0][0], return_index=True)
    return one, np.array([len(kind) for kind, _ in terms])[at], [[v[by][at] for v in seen] for by in range(most)]


def views(runs: linear.Runs) -> list[np.ndarray]:
    """Hashes of words and of their first 4, 5 and 6 bytes, so that unseen endings of a known stem count too."""
    low = kernels.tables()["low"]
    return [runs.hash] + [kernels.hash_spans(runs.data, runs.start, np.minimum(runs.start + n, runs.end), low) for n in PREFIXES]


def extractor(bits: int, identities: tuple[tuple[str, ...], ...] = ()):
    """Features; with ``identities`` those of each counterfactual too, with a mark of the rows that have it; the last names no group."""

    def features(hashes, row, rows):
        grams = [linear.ngrams(h, row, 1, 20 + i) for i, h in enumerate(hashes)]
        bound, index, _ = linear.counted(np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]), rows, bits)
        return bound, index, np.ones(len(index), np.float32)

    def extract(column: pa.Array):
        runs, rows = linear.Runs(column, lower=True, signs=False), len(column)
        row, hashes = runs.row(), views(runs)
        found = features(hashes, row, rows)
        if not identities:
            return found, []
        terms, kind, others = swaps(identities)
        at = np.minimum(np.searchsorted(terms, runs.hash), len(terms) - 1)
        hit = terms[at] == runs.hash
        size = np.zeros(rows, np.int64)  # of the largest kind that a row names
        np.maximum.at(size, row[hit], kind[at[hit]])
        out = []
        for by in range(1, int(size.max(initial=0))):
            named = size > by
            here = named[row]
            swapped = [np.where(hit, o[at], h)[here] for o, h in zip(others[by], hashes, strict=True)]
            out.append((*features(swapped, row[here], rows), named))
        if hit.any():
            here = (size > 0)[row] & ~hit
            out.append((*features([h[here] for h in hashes], row[here], rows), size > 0))
        return found, out

    return extract


def train(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity()) -> np.ndarray:
    return linear.fit(linear.training_rows(docs, labels, "toxic", extractor(how.ftrl.bits, how.identities), how.rows, how.features), how.ftrl)


def scores(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, held_out, score, predicted, row for row of ``docs``."""
    out = linear.scored(docs.select("doc_id", "text"), train(docs, labels, how), extractor(how.ftrl.bits))
    return out.select("doc_id", linear.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= how.threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity()) -> DataFrame:
    """``docs`` without those scored at or above the threshold; columns as they are."""
    name = kernels.unused("__toxicity", docs.columns)
    out = linear.scored(docs, train(docs, labels, how), extractor(how.ftrl.bits), name)
    return out.filter(F.col(name) < how.threshold).drop(name)
