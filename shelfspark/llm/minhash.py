"""Near-duplicate documents: MinHash signatures joined through an inverted index of their coordinates.

Each distinct shingle set is posted under its coordinate-value pairs.  Two sets that agree on at least
``matches`` of ``coordinates`` share one of the rarest ``m - matches + 1`` of the m pairs that either has
in common with any other set, so only that prefix is joined and the longest posting lists are skipped.
Pairs found are counted on whole signatures and confirmed on whole shingle sets.

Large groups do not become all pairs.  Equal sets are collapsed first.  Then each set is compared with two
pivots of every list it is posted in (the set whose pairs are most common, and the smallest id), confirmed
links are merged to components, and lists within one component are done.  In lists that hold several, each set is compared
with the best linked set of the component that has most of the list, which joins the edges of a group to its middle.
Sets of different components that still share a list are paired, at the rarest coordinate they share.  Three filters keep the many sets that are
near a large group, but not in it, from being paired up.  A set's shingles that no other set has cannot be shared, which
bounds the similarity of a set, and of a pair.  And a sketch of ``bits`` cells holds whether a cell has an odd number of the
set's shingles: two sketches differ in no more cells than the sets do in shingles, and no pair is lost to that.  Where many
shingles meet in few cells, the cells in which a pair at the threshold differs stay below McDiarmid's bound for chance ``missed``: each
of d shingles by itself changes two cells at most, so sqrt(2 d ln(1/missed)) above their expected number.
Posting lists are joined in parts of ``part_rows`` sets, in the end each part with each, so one very common pair is no task of its own.

``missed`` is the chance at which a pair exactly at the threshold may be lost, for coordinates and for cells.  With 0
nothing is: shingles themselves are posted, each set under the rarest of its own that any similar set has to share.

Nulls and empties: a null or empty text, or one without words, has no shingles and links with nothing.  A
row with a null ``doc_id`` is returned with a null component and kept.  Rows that repeat a ``doc_id`` are
rows of their own, each linked by its own text; what one of them reaches counts for that one.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, kernels, store


@dataclass(frozen=True)
class NearDup:
    """``percent``: 100 * |A & B| >= percent * |A | B| links two documents, on shingles of ``words`` words.

    ``missed`` bounds the chance that a pair exactly at the threshold falls below the signature's match count; 0 posts shingles.
    """

    words: int = 5
    percent: int = 80
    coordinates: int = 32
    missed: float = 1e-9
    bits: int = 1024
    part_rows: int = 1000
    seed: int = 11

    @property
    def matches(self) -> int:
        p, below, t = self.percent / 100, 0.0, 0
        while t < self.coordinates and (below := below + chance(self.coordinates, t, p)) <= self.missed:
            t += 1
        return max(t, 1)


def chance(n: int, t: int, p: float) -> float:
    """Of exactly ``t`` successes in ``n`` trials."""
    if not 0 < p < 1:
        return float(t == n * p)
    return exp(lgamma(n + 1) - lgamma(t + 1) - lgamma(n - t + 1) + t * log(p) + (n - t) * log(1 - p))


def fingerprints(found: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set, which together with its size tell it from others."""
    return kernels.reduced(np.add, found, bound, 0).view(np.int64), kernels.reduced(np.add, kernels.mix(found ^ np.uint64(0x5BD1E995)), bound, 0).view(np.int64)


def _signatures(how: NearDup):
    words, k, seed = how.words, how.coordinates, how.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, factor = kernels.seeded(k, seed), kernels.seeded(k, seed + 1)
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                found, bound = kernels.shingles(kernels.Words(part.column("text")), words)
                found, bound = kernels.distinct(found, bound)
                n = np.diff(bound)
                coordinates = np.empty((len(n), k), np.int64)
                for i in range(k):
                    low = kernels.reduced(np.minimum, kernels.mix((found ^ xor[i]) * factor[i]), bound, 0)
                    coordinates[:, i] = ((low >> np.uint64(34)) | (np.uint64(i) << np.uint64(32))).astype(np.int64)
                coordinates[n == 0] = 0
                flat = pa.array(coordinates.ravel())
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "text_hash": part.column("text_hash"),
                        "n": pa.array(n, pa.int64()),
                        **{name: pa.array(v) for name, v in zip(("f1", "f2"), fingerprints(found, bound), strict=True)},
                        "pairs": pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * k, pa.int32()), flat),
                    }
                )

    return run


def _sets(how: NearDup):
    """Shingles of each class from the one text of its representative's rows that has its fingerprints."""
    words = how.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                found, bound = kernels.distinct(*kernels.shingles(kernels.Words(part.column("text")), words))
                n, own = np.diff(bound), fingerprints(found, bound)
                same = (n == part.column("n").to_numpy()) & (own[0] == part.column("f1").to_numpy()) & (own[1] == part.column("f2").to_numpy())
                out = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(found.view(np.int64)))
                yield pa.record_batch({"cid": part.column("cid"), "shingles": out}).filter(pa.array(same))

    return run


def _cells(how: NearDup):
    n = how.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, n // 64), np.int64)
            for i, x in enumerate(batch.column("shingles")):
                cell = kernels.mix(x.values.to_numpy().view(np.uint64) + np.uint64(how.seed)) % np.uint64(n)
                odd = np.bincount(cell.astype(np.int64), minlength=n) & 1
                out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
            bound = np.arange(batch.num_rows + 1, dtype=np.int32) * (n // 64)
            yield pa.record_batch({"cid": batch.column("cid"), "cells": pa.ListArray.from_arrays(pa.array(bound), pa.array(out.ravel()))})
            kernels.freed()

    return run


def _confirm(how: NearDup):
    percent = how.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                both = len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            kernels.freed()

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Those (a, b) whose whole shingle sets are similar enough."""
    joined = (
        pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
        .join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
        .select("a", "b", "x", "y")
    )
    kind = dict(pairs.dtypes)["a"]
    return joined.mapInArrow(_confirm(how), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id), row for row of ``docs``."""
    return placed(docs, how).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def unique(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, of several the text whose hash is lowest, of equal rows one.
    Rows that link with nothing, or have no id, stay as they are."""
    rows = store.stored(placed(docs, how).filter("n > 0 and doc_id is not null").select("doc_id", "text_hash", "component"), "components")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    gone = rows.join(first, "component").filter("doc_id <> first.doc_id or text_hash <> first.text_hash")
    d, h, mine = (kernels.unused(f"__{x}", docs.columns) for x in ("d", "h", "t"))
    of = lambda df: df.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    hashed = docs.withColumn(mine, F.xxhash64("text"))
    same = (F.col("doc_id") == F.col(d)) & (F.col(mine) == F.col(h))
    out = hashed.join(of(gone), same, "left_anti")
    repeated = rows.groupBy("doc_id", "text_hash").count().filter("count > 1")
    if repeated.limit(1).count():
        out = out.join(of(repeated), same, "left_anti").unionAll(out.join(of(repeated), same, "left_semi").dropDuplicates(["doc_id", mine]))
    return out.select(*docs.columns)


def placed(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """doc_id, text_hash, n, component (a number), component_id, row for row of ``docs``."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = store.stored(docs.mapInArrow(_signatures(how), f"doc_id {kind}, text_hash long, n long, f1 long, f2 long, pairs array<long>"), "signatures")
    linked = rows.filter("n > 0 and doc_id is not null")

    # a class is one shingle set; its number is fixed by storing it
    same = linked.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("pairs").alias("pairs"))
    same = store.stored(same.select(F.monotonically_increasing_id().alias("cid"), "rep", "f1", "f2", "n", "pairs"), "classes")
    repeated = linked.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0

    def whole(classes: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").alias("rep"), "text").join(classes.select("cid", "rep", "f1", "f2", "n"), "rep")
        found = texts.mapInArrow(_sets(how), "cid long, shingles array<long>")
        return store.stored(found.dropDuplicates(["cid"]) if repeated else found, "sets")

    if how.missed:
        least, posted = F.lit(how.matches), same.select("cid", "rep", "n", F.explode("pairs").alias("pair"))
    else:
        sets = whole(same)
        least, posted = F.ceil(F.col("n") * how.percent / 100).cast("int"), sets.join(same.select("cid", "rep", "n"), "cid").select("cid", "rep", "n", F.explode("shingles").alias("pair"))
    shared = posted.groupBy("pair").count().filter("count > 1")
    # pairs that no other set has cannot match; what is left is ordered from the rarest on
    ordered = (
        posted.join(shared, "pair")
        .groupBy("cid", "rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("count", "pair"))).alias("found"), F.sum(F.log2("count")).alias("common"))
        .filter(F.size("found") >= least)
    )
    ordered = store.stored(ordered, "ordered")
    if how.missed:
        sets = whole(same.join(ordered.select("cid"), "cid", "left_semi"))
    # a set that alone has too many of its shingles is similar enough to none
    each = sets.select("cid", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("cid").alias("many"), F.min("cid").alias("cid"))
    single = each.filter("many = 1").groupBy("cid").agg(F.count("shingle").alias("single"))
    live = ordered.join(single, "cid", "left").withColumn("common_n", F.col("n") - F.coalesce("single", F.lit(0))).drop("single").filter(F.col("common_n") * 100 >= F.col("n") * how.percent)
    first_pairs = F.explode(F.slice("found", 1, F.size("found") - (least - 1))).alias("p")
    prefix = live.select("cid", "rep", "n", "common", "common_n", F.col("found.pair").alias("pairs"), first_pairs)
    # a list is dealt into parts of about part_rows sets
    parts = F.ceil(F.col("p.count") / how.part_rows).cast("int")
    prefix = prefix.select("cid", "rep", "n", "common", "common_n", "pairs", "p.pair", parts.alias("parts"), F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"))
    prefix = store.stored(prefix, "prefix")
    each_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    pivots = prefix.groupBy("pair").agg(F.count("cid").alias("many"), F.min_by("cid", "rep").alias("low"), F.max_by("cid", F.struct("common", "cid")).alias("hub"), F.first("parts").alias("parts"))
    pivots = pivots.filter("many > 1").select("pair", each_part, F.array("low", "hub").alias("pivots"))

    def compared(rows: DataFrame, pivots: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(pairs of the rows' sets with the pivots of their lists, those of them that are links)."""
        starred = rows.join(pivots, ["pair", "part"]).select("cid", F.explode("pivots").alias("pivot")).filter("cid <> pivot")
        pairs = starred.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
        pairs = store.stored(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"), "stars")
        return pairs, store.stored(confirmed(pairs, sets, how), "links")

    def spread(components: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows with their component, number of rows of each component in each list that holds several)."""
        rows = prefix.join(components, prefix.cid == components.node, "left").select("cid", "n", "common_n", "pairs", "pair", "parts", "part", F.coalesce("component", "cid").alias("comp"))
        several = rows.groupBy("pair").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.first("parts").alias("parts")).filter("x <> y").select("pair", each_part)
        return rows, several

    stars, links = compared(prefix, pivots)
    first = graph.components(links)
    rows_, several = spread(first)
    best = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count().join(first, "node").groupBy("component").agg(F.max_by("node", F.struct("count", "node")).alias("middle"))
    most = rows_.join(several, ["pair", "part"], "left_semi").groupBy("pair", "parts", "comp").count().groupBy("pair").agg(F.max_by("comp", F.struct("count", "comp")).alias("comp"), F.first("parts").alias("parts"))
    middles = most.join(best, most.comp == best.component).select("pair", each_part, F.array("middle").alias("pivots"))
    more_stars, more_links = compared(prefix, middles, stars)
    second = graph.components(links.unionAll(more_links))
    rows_, several = spread(second)
    open_ = store.stored(rows_.join(several, ["pair", "part"], "left_semi"), "open")
    cells = store.stored(sets.join(open_.select("cid").distinct(), "cid", "left_semi").mapInArrow(_cells(how), "cid long, cells array<long>"), "cells")
    left = store.stored(open_.join(cells, "cid"), "left")
    store.dropped(open_, cells)
    # a list of several parts is a triangle of blocks, each part with itself and with those behind it
    a = left.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1))).alias("a")
    b = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("part")))).alias("b")
    both_n = F.col("a.n") + F.col("b.n")
    differ = sum((F.bit_count(F.get("a.cells", F.lit(i)).bitwiseXOR(F.get("b.cells", F.lit(i)))) for i in range(how.bits // 64)), F.lit(0))
    most = both_n * (100 - how.percent) / (100 + how.percent)  # shingles in which a similar pair differs
    common = F.array_intersect("a.pairs", "b.pairs")
    if how.missed:
        expected = how.bits / 2 * (1 - F.pow(F.lit(1 - 2 / how.bits), most))
        enough = (differ <= F.least(most, expected + F.sqrt(most * (2 * log(1 / how.missed))))) & (F.size(common) >= how.matches)
    else:
        enough = (differ <= most) & (F.size(common) * (100 + how.percent) >= both_n * how.percent)
    open_pairs = a.join(
        b,
        (F.col("a.pair") == F.col("b.pair"))
        & (F.col("a.part") == F.col("b.other"))
        & (F.col("a.other") == F.col("b.part"))
        & ((F.col("a.part") < F.col("b.part")) | (F.col("a.cid") < F.col("b.cid")))
        & (F.col("a.comp") != F.col("b.comp"))
        & (F.least("a.common_n", "b.common_n") * (100 + how.percent) >= both_n * how.percent)
        & enough
        & (F.get(common, F.lit(0)) == F.col("a.pair")),  # each pair once, at the rarest coordinate that it shares
    ).select(F.least("a.cid", "b.cid").alias("a"), F.greatest("a.cid", "b.cid").alias("b"))
    open_pairs = store.stored(open_pairs.join(stars.unionAll(more_stars), ["a", "b"], "left_anti"), "open-pairs")
    more = store.stored(confirmed(open_pairs, sets, how), "more")
    final = graph.components(links.unionAll(more_links).unionAll(more))
    store.dropped(ordered, sets, prefix, stars, more_stars, left, open_pairs, links, more_links, more, first, second)

    numbered = same.join(final, same.cid == final.node, "left").select("f1", "f2", "n", "rep", F.coalesce("component", "cid").alias("component"))
    least_id = numbered.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = numbered.drop("rep").join(least_id, "component")
    whole_rows = linked.select("doc_id", "text_hash", "n", "f1", "f2").join(classes, ["f1", "f2", "n"]).select("doc_id", "text_hash", "n", "component", "component_id")
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return whole_rows.unionAll(alone)
