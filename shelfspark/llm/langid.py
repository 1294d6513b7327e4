"""Language identification by rank-order profiles.

A profile is the most frequent letter n-grams (1 to 3 letters, words padded with a blank) in order of frequency.  A
document is put to the language whose profile is nearest by out-of-place distance: the sum, over the document's
own most frequent n-grams, of how far each one's rank is from its rank in the profile, or ``top`` if it is not there.
An n-gram is its code points themselves, 21 bits each, so every script is treated alike and none are mixed up.

Profiles are sums over all documents that may be learnt from.  A null text, or one without a letter (Unicode category L), is ``und`` with
score 0; combining marks belong to words but are no letters.  Rows with a null ``lang`` or ``doc_id`` are never learnt from; if nothing can be, every row is ``und``.
Equal distances go to the language that sorts first.  Rows that repeat a ``doc_id`` are predicted each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, linear

UNKNOWN = "und"
U21, TWO, THREE = np.uint64(21), np.uint64(1 << 63), np.uint64(1 << 63 | 1 << 62)


@dataclass(frozen=True)
class Profiles:
    top: int = 400
    most_languages: int = 1000
    held: int = 4_000_000  # counts that a task holds before it passes them on


#: Code points of a text that are worked on at once.
PIECE = 1 << 20


def kinds() -> np.ndarray:
    """Of each code point: 1 a letter, 2 a combining mark, 0 anything else."""
    return kernels.once("kinds", _kinds)


def _kinds() -> np.ndarray:
    return np.array([1 if chr(i).isalpha() else 2 if unicodedata.category(chr(i))[0] == "M" else 0 for i in range(0x110000)], np.uint8)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of 1 to 3 letters in ascending order, how often each occurs); none for a text without letters.

    Runs of anything but letters and marks are one blank, also before and behind; a blank alone is no n-gram."""
    found, last, any_ = [], np.zeros(1, np.uint64), False
    for at in range(0, len(text) or 1, PIECE):
        end = " " if at + PIECE >= len(text) else ""
        code = np.frombuffer((text[at : at + PIECE].lower() + end).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds()[code]
        any_ |= bool((kind == 1).any())
        code = np.concatenate([last, np.where(kind > 0, code, 0).astype(np.uint64)])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
        c, old = code[keep], len(last)
        new = c[old:] if len(last) else c
        two, three = c[:-1] << U21 | c[1:], (c[:-2] << U21 | c[1:-1]) << U21 | c[2:]
        # a mark of its length, since a blank is 0; n-grams that lie in what the last piece had are not counted again
        found.append(np.unique(np.concatenate([new[new > 0], (two | TWO)[max(old - 1, 0) :], (three | THREE)[max(old - 2, 0) :]]), return_counts=True))
        last = c[-2:]
    if not any_:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return merged(found)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all parts by n-gram."""
    if len(parts) == 1:
        return parts[0]
    one, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return one, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(one)).astype(np.int64)


def ranked(gram: np.ndarray, count: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` n-grams with the highest counts, from the most frequent on; ties by n-gram, which ascend."""
    if len(gram) > top:
        least = np.partition(count, len(count) - top)[len(count) - top]
        gram, count = gram[count >= least], count[count >= least]
    return gram[np.argsort(-count, kind="stable")][:top]


def profiles(docs: DataFrame, how: Profiles = Profiles()) -> dict[str, np.ndarray]:
    """The n-grams of each language in order.  Counts are summed by task, then by language; ``top`` rows a language reach the driver."""
    held_most = how.held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        held = 0

        def out():
            for lang, parts in total.items():
                gram, n = merged(parts)
                yield pa.record_batch({"lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram.view(np.int64)), "n": pa.array(n)})
            total.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                parts = total.setdefault(lang, [])
                parts.append(grams(text.as_py()))
                held += len(parts[-1][0])
                if len(parts) >= 64:
                    held -= sum(len(g) for g, _ in parts)
                    total[lang] = [merged(parts)]
                    held += len(total[lang][0][0])
                if held > held_most:  # partial counts; the engine adds them up
                    yield from out()
                    held = 0
        yield from out()

    learnt = docs.select("doc_id", "lang", "text").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~linear.held_out(F.col("doc_id"), 4, 2))
    counts = learnt.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    rows = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.top).limit(how.top * how.most_languages + 1).collect()
    if len(rows) > how.top * how.most_languages:
        raise ValueError(f"more than {how.most_languages} languages; pass most_languages to allow it")
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(found, np.int64).view(np.uint64) for lang, found in out.items()}


def predict(docs: DataFrame, how: Profiles = Profiles()) -> DataFrame:
    """doc_id, held_out, lang_pred, score (how much nearer the best profile is than the farthest possible), row for row of ``docs``."""
    learnt = profiles(docs, how)
    names, top = sorted(learnt), how.top
    known = np.unique(np.concatenate([*learnt.values(), np.zeros(1, np.uint64)]))
    place = np.full((max(len(names), 1), len(known)), -1, np.int32)
    for i, name in enumerate(names):
        place[i, np.searchsorted(known, learnt[name])] = np.arange(len(learnt[name]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for text in batch.column("text"):
                gram, count = grams(text.as_py()) if text.is_valid else ((), ())
                best, near = UNKNOWN, 0.0
                if len(gram) and names:
                    own = ranked(gram, count, top)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    ranks = np.where(known[at] == own, place[:, at], -1)
                    far = np.where(ranks < 0, top, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
                    i = int(far.argmin())
                    best, near = names[i], float(1 - far[i] / (top * len(own)))
                pred.append(best)
                score.append(near)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", linear.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
