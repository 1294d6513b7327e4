"""Source divergence audit: how far the sources of a language differ, and in which terms.

A source's weight of a term is p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)) over the V terms that its language keeps, N being
the source's occurrences of them; two weights differ by f = floor((p - q)^2 / (p + q)).  Summed over all V terms, f of two
sources starts at V times f of their weights of a count of zero.  An inverted index of the terms (postings of source and count)
emits what is to be corrected, and only where that is not zero: for each source and count how often it occurs, against every
other source's zero; and for terms that both have, what their counts together change beyond that.  Sums and f are exact: they stay below
2^60, and products that may not are made in decimals of 38 digits.

A term's postings are one row, as long as the sources that have it; the result has a row for each pair of sources of a
language, so those are few.  Terms are counted in the tasks that read them, texts are never exploded, and a hot source
or term is summed up before each shuffle.

Nulls: text, language and source read as ''.  A row is a document, repeated ids or not.  Groups without terms take part with
counts of zero, a language that keeps no term has pairs of value 0 and no terms.  An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, store

#: Bytes of text whose terms are counted together; they take some twenty times as much memory.
SLICE = 8 << 20


@dataclass(frozen=True)
class Audit:
    """``least``: documents of its language that a term has to be in; ``top``: ranks of the ``term`` part; ``few``: as many groups at
    most are sent to every task."""

    least: int = 10
    top: int = 10
    scale: int = 1_000_000_000
    few: int = 20_000


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(whether a byte belongs to a term, its lower case): ASCII letters and all of non-ASCII; only A to Z change."""
    inside, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    inside[65:91] = inside[97:123] = inside[128:] = True
    lower[65:91] += 32
    return inside, lower


def terms(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(terms of all rows one behind the other, row of each)."""
    data, offsets = kernels.utf8(column)
    letter, lower = _letters()
    inside = letter[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[starts] = inside[starts]
    at = np.flatnonzero(first)
    letters = np.cumsum(inside)
    # the letters alone, one term behind the other; a term begins where one is first
    begin = letters[at] - 1
    kept = lower[data[inside]]
    bound = np.append(begin, len(kept)).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bound), pa.py_buffer(kept)])
    return flat.dictionary_encode(), np.searchsorted(offsets, at, "right") - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice the occurrences of each term in each group, and the documents that have it."""
    for batch in batches:
        for part in kernels.slices(batch, "text", SLICE):
            words, row = terms(part.column("text"))
            size = max(1, len(words.dictionary))
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            in_doc, count = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
            groups, of = np.unique(group, return_inverse=True)
            key, at, docs = np.unique(of[in_doc // size] * size + in_doc % size, return_inverse=True, return_counts=True)
            group = groups[key // size]
            yield pa.record_batch(
                {
                    "lang": lang.dictionary.take(pa.array(group // len(source.dictionary))),
                    "source": source.dictionary.take(pa.array(group % len(source.dictionary))),
                    "term": words.dictionary.take(pa.array(key % size)).cast(pa.string()),
                    "count": pa.array(np.bincount(at, weights=count, minlength=len(key)).astype(np.int64)),
                    "docs": pa.array(docs.astype(np.int64)),
                }
            )


def weight(count: str, total: str, kept: str, scale: int) -> Column:
    """1 + floor(scale * (count + 2) / (total + 2 * kept)) of columns, exact; null where nothing is kept."""
    return F.when(F.col(kept) > 0, F.expr(f"1 + cast({scale} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({total} + 2 * {kept} as decimal(20,0))"))


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of columns below 2^31, exact."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences, and documents with the term, of each group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    each = read.mapInArrow(_counts, "lang string, source string, term string, count long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def indexed(docs: DataFrame, how: Audit = Audit()) -> tuple[DataFrame, DataFrame]:
    """(postings lang, term, total, found: array of (source, count); groups lang, source, kept, total, zero, lang_total), both stored."""
    postings = counted(docs).groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("found"))
    postings = store.stored(postings.filter(F.col("docs") >= how.least).drop("docs"), "postings")
    kept = postings.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    totals = postings.select("lang", F.explode("found").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.count").alias("total"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("none", F.lit(0).cast("long")).withColumn("zero", weight("none", "total", "kept", how.scale)).drop("none")
    return postings, store.stored(groups, "groups")


def audit(docs: DataFrame, how: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank.  Part ``pair``: every other source of the language and f of the two, summed over all kept
    terms.  Part ``term``: the ``top`` terms that the source has and weighs higher than its language does, with f of the two weights."""
    postings, groups = indexed(docs, how)
    few = groups.count() <= how.few
    known = F.broadcast(groups) if few else groups
    each = postings.select("lang", "term", F.col("total").alias("term_total"), F.explode("found").alias("x")).select("lang", "term", "term_total", "x.source", "x.count").join(known, ["lang", "source"])
    each = each.withColumn("p", weight("count", "total", "kept", how.scale)).withColumn("q", weight("term_total", "lang_total", "kept", how.scale))
    each = store.stored(each.select("lang", "source", "term", "p", "zero", "q"), "weights")

    higher = each.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    higher = higher.withColumn("rank", rank).filter(F.col("rank") <= how.top)

    others = known.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    start = groups.join(others, "lang").filter("source <> item")
    start = start.select("lang", "source", "item", F.coalesce(F.col("kept") * distance("zero", "other"), F.lit(0).cast("long")).alias("value"))
    # what a source's counts change against another's zero: once for each count that occurs
    levels = each.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("n"))
    alone = levels.join(others, "lang").filter("source <> item").select("lang", "source", "item", (F.col("n") * (distance("p", "other") - distance("zero", "other"))).alias("value")).filter("value <> 0")
    # and what the counts of two sources that both have a term change beyond that
    lists = each.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("found"))
    two = lists.select("lang", "found", F.posexplode("found").alias("i", "x")).select("lang", "x", F.explode(F.slice("found", F.col("i") + 2, F.size("found"))).alias("y"))
    change = distance("x.p", "y.p") - distance("x.p", "y.zero") - distance("x.zero", "y.p") + distance("x.zero", "y.zero")
    both = two.select("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), change.alias("value")).filter("value <> 0")
    half = alone.unionAll(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    half = store.stored(half, "corrections")
    pairs = start.unionAll(half).unionAll(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", rank).unionAll(higher)
