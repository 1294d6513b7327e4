"""Mixing sources to target weights, in blocks of words.

Each source's documents, in a fixed pseudo-random order, form one stream of words that is packed into blocks
of a fixed length.  The mix is laid out in output shards of slots.  For each shard a multinomial draw says how many
slots each source fills: the slots of all shards are split between two halves of them by a draw over what every source
has to give, each half's again, down to single shards, so any task draws its own shards without those before them.
The source's n-th slot takes the block at place n of a pseudo-random permutation of its blocks, one permutation for
each pass.  Blocks and slots are joined by (source, block).  What is split are whole-block targets, so the totals meet
the targets and no block is taken more often than ``most`` times.

Sources are ordered by code point, null last, and weigh ``weights`` in turn.  Targets are min(most * size,
level * weight), with the level at which they add up to all words.  A source that could not fill ``least``
blocks gets shorter ones.  Documents without words, or with a null text, take no part (taken 0).  Rows that
repeat a ``doc_id`` are rows of their own; equal ones have places in the stream of their own too, and since they are
interchangeable it does not matter which has which.  Extra columns are ignored by ``plan`` and kept by ``mixed``.
An empty table gives an empty result.

The driver and each task that draws hold one row for each source (at most ``most_sources``, else ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, store


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    most: int = 3
    block: int = 256
    least: int = 256
    shard_slots: int = 4096
    bucket_rows: int = 10_000
    most_sources: int = 100_000
    seed: int = 7


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size; the excess is shared again by weight."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else weights[i] * unit
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def drawn(left: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``want`` slots each source fills, none more than it has ``left``."""
    left, got = left.copy(), np.zeros(len(left), np.int64)
    while want:
        more = np.minimum(rng.multinomial(want, left / left.sum()), left)
        got, left, want = got + more, left - more, want - int(more.sum())
    return got


def draws(quota: np.ndarray, shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source, slots of each source in all shards before) for shards ``first`` up to ``last``."""
    total = int(quota.sum())
    todo = [(0, shards, quota, np.zeros(len(quota), np.int64))]
    while todo:
        low, high, own, before = todo.pop()
        if high <= first or last <= low:
            continue
        if high - low == 1:
            yield low, own, before
            continue
        half = (low + high) // 2
        got = drawn(own, total * half // shards - total * low // shards, np.random.default_rng([seed, low, high]))
        todo += [(half, high, own - got, before + got), (low, half, got, before)]


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of ``i`` in a pseudo-random permutation of range(n): a Feistel network, walked until it is inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            left, right = right, left ^ (kernels.mix(right + np.uint64(kernels.mix_int(key * 4 + r))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in kernels.slices(batch, "text"):
            size = kernels.Words(part.column("text"), hashes=False).counts
            yield pa.record_batch({"doc_id": part.column("doc_id"), "source": part.column("source"), "text_hash": part.column("text_hash"), "size": pa.array(size, pa.int64())})


def _slots(how: Mix, quota: np.ndarray, blocks: np.ndarray, shards: int, at_once: int = 64):
    """Blocks of the slots of the shards numbered by ``id``."""
    seed, most = how.seed, how.most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for first in range(0, len(ids), at_once):
                part = ids[first : first + at_once]
                found = [(s, np.flatnonzero(got), got, before) for s, got, before in draws(quota, shards, int(part[0]), int(part[-1]) + 1, seed)]
                sid = np.concatenate([np.repeat(w, got[w]) for _, w, got, _ in found])
                slot = np.concatenate([np.arange(got.sum()) - np.repeat(np.cumsum(got[w]) - got[w] - before[w], got[w]) for _, w, got, before in found])
                shard = np.repeat([s for s, *_ in found], [int(got.sum()) for _, _, got, _ in found])
                turn, block = slot // blocks[sid], slot % blocks[sid]
                order = np.lexsort((turn, sid))
                edge = np.flatnonzero(np.diff(sid[order]) | np.diff(turn[order])) + 1
                for own in np.split(order, edge) if len(order) else ():
                    s, n = int(sid[own[0]]), int(blocks[sid[own[0]]])
                    block[own] = permuted(block[own], n, kernels.mix_int((seed << 40) + (s * (most + 1) + int(turn[own[0]]))))
                yield pa.record_batch({"sid": pa.array(sid.astype(np.int64)), "shard": pa.array(shard.astype(np.int64)), "block": pa.array(block)})

    return run


def plan(docs: DataFrame, how: Mix = Mix()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, pieces, slots): ``rows`` doc_id, source, text_hash, size, source_size, target, sid, length, copies, copy, start, the
    last two numbering and placing equal rows, null without words; ``pieces`` sid, start, block, words: which words of a row lie in
    which block; ``slots`` sid, shard, block: the blocks of each output shard, one row for each time a block is taken."""
    spark = docs.sparkSession
    read = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    kinds = dict(read.dtypes)
    sizes = store.stored(read.mapInArrow(_sizes, f"doc_id {kinds['doc_id']}, source {kinds['source']}, text_hash long, size long"), "sizes")
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(how.most_sources + 1).collect()
    if len(found) > how.most_sources:
        raise ValueError(f"more than {how.most_sources} sources; pass most_sources to allow it")
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.size for r in found], [how.weights[i % len(how.weights)] for i in range(len(found))], how.most)
    length = [max(1, min(how.block, r.size // how.least)) for r in found]
    blocks = np.array([-(-r.size // b) for r, b in zip(found, length, strict=True)], np.int64)
    quota = np.array([min(how.most * int(n), round(g / max(r.size, 1) * int(n))) for n, g, r in zip(blocks, goal, found, strict=True)], np.int64)
    sources = spark.createDataFrame(
        [(i, r.source, r.size, g, b) for i, (r, g, b) in enumerate(zip(found, goal, length, strict=True))],
        f"sid long, source {kinds['source']}, source_size long, target double, length long",
    )
    if len(found) <= 10_000:
        sources = F.broadcast(sources)
    buckets = max(1, sum(r.n for r in found) // how.bucket_rows)
    with_source = lambda df: df.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.sid", "s.source_size", "s.target", "s.length")
    # equal rows are one group until their places are known
    groups = with_source(sizes.filter("size > 0").groupBy("source", "doc_id", "text_hash", "size").agg(F.count(F.lit(1)).alias("copies")))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(how.seed)), F.lit(buckets)))
    # a group's place in its source's stream: words of earlier buckets, then of earlier groups in its own
    words = F.col("size") * F.col("copies")
    inside = F.sum(words).over(Window.partitionBy("sid", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1))
    sums = groups.groupBy("sid", "bucket").agg(F.sum(words).alias("all"))
    # in two levels: a source may have very many buckets
    shelf = F.shiftright("bucket", 12).alias("shelf")
    within = F.sum("all").over(Window.partitionBy("sid", "shelf").orderBy("bucket")) - F.col("all")
    shelves = sums.groupBy("sid", shelf).agg(F.sum("all").alias("whole")).select("sid", "shelf", (F.sum("whole").over(Window.partitionBy("sid").orderBy("shelf")) - F.col("whole")).alias("before"))
    sums = sums.withColumn("shelf", shelf).withColumn("within", within).join(shelves, ["sid", "shelf"]).select("sid", "bucket", (F.col("before") + F.col("within")).alias("earlier"))
    placed = groups.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, ["sid", "bucket"])
    # copies in two steps, so that no row becomes one very long array
    placed = placed.withColumn("thousand", F.explode(F.expr("sequence(0, (copies - 1) div 1000)")))
    placed = placed.withColumn("copy", F.explode(F.expr("sequence(thousand * 1000, least(copies, thousand * 1000 + 1000) - 1)")))
    columns = ["doc_id", "source", "text_hash", "size", "source_size", "target", "sid", "length", "copies", "copy"]
    placed = placed.select(*columns, (F.col("inside") + F.col("earlier") + F.col("copy") * F.col("size")).alias("start"))
    without = with_source(sizes.filter("size = 0")).select(*columns[:8], *[F.lit(None).cast("long").alias(c) for c in ("copies", "copy", "start")])
    rows = store.stored(placed.unionAll(without), "mix-rows")
    store.dropped(sizes)
    last = F.col("start") + F.col("size")
    pieces = rows.filter("size > 0").select("sid", "start", "size", "length", F.explode(F.expr("sequence(start div length, (start + size - 1) div length)")).alias("block"))
    pieces = pieces.select("sid", "start", "block", (F.least(last, (F.col("block") + 1) * F.col("length")) - F.greatest("start", F.col("block") * F.col("length"))).alias("words"))
    total = int(quota.sum())
    shards = -(-total // how.shard_slots)
    slots = spark.range(0, shards, 1, max(1, total // 1_000_000 + 1)).mapInArrow(_slots(how, quota, blocks, shards), "sid long, shard long, block long")
    return rows, pieces, slots


def _taken(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    return pieces.join(_times(slots), ["sid", "block"])


def _times(slots: DataFrame) -> DataFrame:
    """How often each block is taken.  The planner takes the few rows that slots are made from for their size, so the join's kind is given."""
    return slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times")).hint("shuffle_merge")


def taken(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the row in the mix, repeats counted), row for row of ``docs``."""
    rows, pieces, slots = plan(docs, how)
    words = _taken(pieces, slots).groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    full = rows.filter("size > 0").join(words, ["sid", "start"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    return full.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionAll(rows.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def _cut(names: list[str], plans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                words = kernels.Words(part.column("text"), hashes=False)
                take, texts = [], []
                for i in range(part.num_rows):
                    pieces = sorted((p["block"], p["words"], p["times"]) for p in part.column(plans)[i].as_py())
                    start = words.start[words.bound[i] : words.bound[i + 1]]
                    ends = np.cumsum([p[1] for p in pieces])
                    # a piece runs to the start of the next one; the first and last keep what surrounds them
                    edge = [int(words.offsets[i]), *(int(start[e]) for e in ends[:-1]), int(words.offsets[i + 1])]
                    for copy in range(1, max(p[2] for p in pieces) + 1):
                        take.append(i)
                        texts.append(b"".join(words.data[edge[j] : edge[j + 1]].tobytes() for j, p in enumerate(pieces) if p[2] >= copy).decode())
                out = part.take(pa.array(take, pa.int64()))
                columns = {n: out.column(n) for n in names}
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(x) for x in texts], pa.int64()).cast(columns["n_chars"].type)
                yield pa.record_batch(columns)

    return run


def mixed(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mix itself, with the columns of ``docs``: for each document one row with what is taken at least once, one
    with what is taken at least twice, and so on.  A document taken whole keeps its text as it is."""
    rows, pieces, slots = plan(docs, how)
    # every piece of a row is needed to cut it, so those not taken are kept with 0
    lists = (
        pieces.join(_times(slots), ["sid", "block"], "left")
        .groupBy("sid", "start")
        .agg(F.collect_list(F.struct("block", "words", F.coalesce("times", F.lit(0)).alias("times"))).alias("__pieces"), F.max("times").alias("top"))
        .filter("top > 0")
    )
    own = rows.filter("size > 0").join(lists, ["sid", "start"])
    names = docs.columns
    d, s, h, c, plans, mine, number = (kernels.unused(f"__{x}", names) for x in ("d", "s", "h", "c", "pieces", "t", "n"))
    own = own.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("text_hash").alias(h), F.col("copy").alias(c), F.col("__pieces").alias(plans))
    hashed = docs.withColumn(mine, F.xxhash64("text"))
    if rows.filter("copies > 1").limit(1).count():  # equal rows are numbered, to take one plan each
        hashed = hashed.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", "source", mine).orderBy(mine)) - 1)
    else:
        hashed = hashed.withColumn(number, F.lit(0))
    joined = hashed.join(own, F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(mine) == F.col(h)) & (F.col(number) == F.col(c)))
    return joined.select(*names, plans).mapInArrow(_cut(names, plans), docs.schema)
