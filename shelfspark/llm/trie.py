"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root.  Turn by turn a class is split by what its members say next; a class is
named by its smallest member.  A class of one member is retired: what is left of it is an unary chain, whose nodes follow
from its length alone.  Rounds take blocks of turns, one turn first, then twice as many, up to ``BLOCK``: inside a block the
digests of turns are chained, so (class before the block, depth, chain) names the classes of all its depths at once.  What
nodes sum up over their subtrees is folded back along the way of each node's smallest member, block by block.

A turn is its role and text, told apart by SHA-256; texts themselves are never shuffled.  Turns are dealt by range of
(conversation, turn), so a conversation of any length is ordered by many tasks, and no window or list has more than a block of it.

Nulls and ties: a null ``conv_id`` is no conversation and is left out; a null turn comes first, null roles and texts are empty;
rows with equal turns are ordered by role, then by the text's SHA-256, so repeated rows are turns one behind the other.  An
empty table has no nodes.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Most turns of a block, a power of two; as many ids at most are joined to one piece of text.
BLOCK = 4096
#: Ids of one piece are those that are equal but for so many low bits.
PIECE_BITS = 12
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def block_of(depth: Column) -> Column:
    """0 for depth 1, 1 for 2 and 3, 2 for 4 to 7 and so on up to ``BLOCK`` turns, then blocks of as many."""
    doubled = (F.length(F.bin(depth)) - 1).cast("long")
    return F.when(depth < BLOCK, doubled).otherwise(BLOCK.bit_length() - 2 + F.floor(depth / BLOCK))


def block_bounds(block: int) -> tuple[int, int]:
    """(first depth, depth behind the last) of a block."""
    most = BLOCK.bit_length() - 1
    return (1 << block, 2 << block) if block < most else ((block - most + 1) * BLOCK, (block - most + 2) * BLOCK)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of each row among those of its conversation in this partition, from 1 on, and the partition's number."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        new = np.append(True, conv[1:] != conv[:-1])
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        at = np.arange(len(conv)) - start[run] + 1
        if last == conv[0]:
            at[run == 0] += seen
        last, seen = conv[-1], int(at[-1])
        yield pa.record_batch({"part": pa.array(np.full(len(conv), part, np.int32)), "conv_id": batch.column("conv_id"), "at": pa.array(at), "key": batch.column("key"), "bytes": batch.column("bytes")})


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1 on), key (SHA-256 of role and text), bytes (of the text in UTF-8), stored."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text.cast("binary"), 256).alias("said"), F.octet_length(text).cast("long").alias("bytes"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    keyed = dealt.select("conv_id", F.unhex(F.sha2(F.concat("said", "role").cast("binary"), 256)).alias("key"), "bytes")
    numbered = store.stored(keyed.mapInArrow(_numbered, "part int, conv_id long, at long, key binary, bytes long"), "turns")
    # what partitions before this one have of its first conversation; a row for each partition, of which there are as many as the session shuffles to
    ends = numbered.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by("at", F.struct("conv_id", "at")).alias("n"))
    run = F.sum("n").over(Window.partitionBy("last").orderBy("part"))
    whole = Window.orderBy("part")
    ends = ends.withColumn("run", run).select("part", F.col("first").alias("conv_id"), F.lag("last").over(whole).alias("before"), F.lag("run").over(whole).alias("run"))
    moved = ends.filter("before = conv_id").select("part", "conv_id", F.col("run").alias("by"))
    out = numbered.join(F.broadcast(moved), ["part", "conv_id"], "left").select("conv_id", (F.col("at") + F.coalesce("by", F.lit(0))).alias("pos"), "key", "bytes")
    out.stored_path = numbered.stored_path
    return out


def spliced(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """conv_id, len, pos, key, bytes of rebuilt conversations: the first h turns of conversation c - c % ``group``, then c's own
    behind its first h, with h = crc32(c as text) % ``most``.  A conversation left without turns has one row with a null pos."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = lengths.select("conv_id", "n", h, base).join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = store.stored(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    own = turns.withColumn("h", h).filter("pos > h").drop("h").join(convs, "conv_id").select("conv_id", "len", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "bytes")
    heads = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    head = heads.join(convs, "base").filter("pos <= h").select("conv_id", "len", "pos", "key", "bytes")
    none = convs.filter("len = 0").select("conv_id", "len", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("bytes"))
    return own.unionAll(head).unionAll(none)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's key becomes the digest of all keys of the block up to it."""
    for batch in batches:
        keys = []
        for row in batch.column("turns").to_pylist():
            so_far = hashlib.sha256()
            for turn in row:
                so_far.update(turn["key"])
                keys.append(so_far.digest())
        turns = batch.column("turns")
        many = np.diff(turns.offsets.to_numpy())
        repeat = pa.array(np.repeat(np.arange(batch.num_rows), many))
        flat = turns.flatten()
        yield pa.record_batch({**{c: batch.column(c).take(repeat) for c in ("conv_id", "len", "class")}, "pos": flat.field("pos"), "chain": pa.array(keys, pa.binary()), "bytes": flat.field("bytes")})


def refined(rows: DataFrame) -> DataFrame:
    """(conv_id, len, block, class, way): for each conversation and block the classes of more than one member that it goes
    through, as an array of (pos, id, n, deep, bytes) in order; ``class`` is the one before the block, ``deep`` the greatest length
    of a member.  Block -1 has the root.  Stored."""
    rows = rows.withColumn("block", block_of(F.col("pos")))
    rows = store.stored(rows.sortWithinPartitions("block"), "rebuilt")
    every = rows.select("conv_id", "len").filter("conv_id is not null").groupBy("conv_id").agg(F.max("len").alias("len"))
    root = every.agg(F.min("conv_id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("len").alias("deep")).first()
    step = F.struct(*[F.lit(v).cast("long").alias(c) for c, v in (("pos", 0), ("id", root.id), ("n", root.n), ("deep", root.deep), ("bytes", 0))])
    start = every.select("conv_id", "len", F.lit(-1).cast("long").alias("block"), F.lit(None).cast("long").alias("class"), F.array(step).alias("way"))
    found = [store.stored(start, "ways")]
    active = found[0].filter("way[0].n > 1 and len > 0").select("conv_id", "len", F.col("way")[0]["id"].alias("class"))
    block = 0
    while active.limit(1).count():
        first, behind = block_bounds(block)
        # an active conversation has every turn of the block up to its length
        x = rows.filter(F.col("block") == block).select("conv_id", "pos", "key", "bytes").join(active, "conv_id")
        if behind - first == 1:
            x = x.withColumnRenamed("key", "chain").select("conv_id", "len", "class", "pos", "chain", "bytes")
        else:
            turns = F.sort_array(F.collect_list(F.struct("pos", "key", "bytes"))).alias("turns")
            x = x.groupBy("conv_id", "len", "class").agg(turns).mapInArrow(_chained, "conv_id long, len long, class long, pos long, chain binary, bytes long")
        x = store.stored(x, "chains")
        nodes = x.groupBy("class", "pos", "chain").agg(F.min("conv_id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("len").alias("deep")).filter("n > 1")
        shared = x.join(nodes, ["class", "pos", "chain"])
        way = F.sort_array(F.collect_list(F.struct("pos", "id", "n", "deep", "bytes"))).alias("way")
        ways = store.stored(shared.groupBy("conv_id", "len", "class").agg(way).select("conv_id", "len", F.lit(block).cast("long").alias("block"), "class", "way"), "ways")
        store.dropped(x)
        found.append(ways)
        last = F.element_at("way", -1)
        active = ways.filter((last["pos"] == behind - 1) & (F.col("len") > behind - 1)).select("conv_id", "len", last["id"].alias("class"))
        block += 1
    out = store.stored(reduce(DataFrame.unionAll, found), "ways")
    store.dropped(rows, *found)
    return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class on a way, with what the conversation adds to it: the child and the leaf that it is the smallest member
    of, and the bytes saved in all later classes that it is the smallest member of."""
    for batch in batches:
        if not batch.num_rows:
            continue
        way = batch.column("way")
        bound = way.offsets.to_numpy().astype(np.int64)
        bound -= bound[0]
        many = np.diff(bound)
        row = np.repeat(np.arange(batch.num_rows), many)
        flat = way.flatten()
        pos, ids, n, size = (flat.field(c).to_numpy() for c in ("pos", "id", "n", "bytes"))
        column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "len", "carry", "leaf")}
        conv = column["conv_id"][row]
        own = np.where(ids == conv, (n - 1) * size, 0)
        total = np.concatenate([[0], np.cumsum(own)])
        saved = total[bound[1:]][row] - total[:-1] + column["carry"][row]
        # the id one depth further: in this block, or the first of the next, or the conversation itself once it is alone
        behind = np.append(ids[1:], 0)
        final = bound[1:] - 1
        following = batch.column("following").fill_null(-1).to_numpy()
        going_on = batch.column("following").is_valid().to_numpy(zero_copy_only=False)
        child = behind == conv
        child[final] = np.where(going_on, following == column["conv_id"], column["len"] > pos[final])
        parent = np.append(0, ids[:-1])
        parent[bound[:-1]] = batch.column("class").fill_null(0).to_numpy()
        yield pa.record_batch(
            {
                "depth": pa.array(pos),
                "conv_id": pa.array(ids),
                "parent_conv_id": pa.array(parent, mask=(ids != conv) | (pos == 0)),
                "child": pa.array(child.astype(np.int64)),
                "leaf": pa.array(column["leaf"][row].astype(np.int64)),
                "saved": pa.array(saved),
            }
        )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's pieces one behind the other; a piece is all that is held at a time."""
    at, so_far = None, None

    def done():
        return pa.record_batch({"depth": pa.array([at[0]], pa.int64()), "conv_id": pa.array([at[1]], pa.int64()), "ends_sha256": pa.array([so_far.hexdigest()])})

    for batch in batches:
        for depth, conv, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "ids")), strict=True):
            if (depth, conv) != at:
                if at is not None:
                    yield done()
                at, so_far = (depth, conv), hashlib.sha256(ids.encode())
            else:
                so_far.update(b"," + ids.encode())
    if at is not None:
        yield done()


def nodes(rows: DataFrame) -> DataFrame:
    """The trie's nodes from (conv_id, len, pos, key, bytes): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  Positions of a conversation run from 1 to its length; one without turns has a null pos."""
    ways = refined(rows)
    sums = F.aggregate(F.filter("way", lambda x: x["id"] == F.col("conv_id")), F.lit(0).cast("long"), lambda acc, x: acc + (x["n"] - 1) * x["bytes"])
    last = F.element_at("way", -1)
    blocks = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    at_end = F.when(F.col("len") > last["pos"], F.lit(True)).otherwise((last["id"] == F.col("conv_id")) & (last["deep"] == F.col("len")))
    ways = ways.select(
        "conv_id", "len", "class", "way", F.lag(F.col("way")[0]["id"]).over(blocks).alias("following"),
        F.first(at_end).over(blocks).alias("leaf"), (F.sum(sums).over(blocks) - sums).alias("carry"),
    )
    ways = store.stored(ways, "folds")
    each = ways.mapInArrow(_folded, "depth long, conv_id long, parent_conv_id long, child long, leaf long, saved long")
    shared = each.groupBy("conv_id", "depth").agg(F.max("parent_conv_id").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    finals = ways.filter("following is null").select(F.col("conv_id").alias("member"), "len", last["pos"].alias("depth"), last["id"].alias("conv_id"))
    ended = finals.filter("len = depth").groupBy("depth", "conv_id", F.shiftright("member", PIECE_BITS).alias("piece"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_set("member")), lambda x: x.cast("string")), ",")
    pieces = ended.agg(ids.alias("ids")).repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "piece")
    ends = pieces.select("depth", "conv_id", "ids").mapInArrow(_ends, "depth long, conv_id long, ends_sha256 string")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    shared = shared.join(ends, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))

    # tails of the retired, in pieces of a block
    tails = finals.filter("len > depth").select("member", "len", (F.col("depth") + 1).alias("first"), F.col("conv_id").alias("parent"))
    pieces = tails.select("*", F.explode(F.sequence("first", "len", F.lit(BLOCK).cast("long"))).alias("from")).repartition("member", "from")
    chain = pieces.select("*", F.explode(F.sequence("from", F.least("len", F.col("from") + BLOCK - 1))).alias("depth"))
    long = lambda c: c.cast("long")
    chain = chain.select(
        F.col("member").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("member")).alias("parent_conv_id"),
        long(F.lit(1)).alias("n_convs"), long(F.col("depth") < F.col("len")).alias("n_children"), long(F.lit(1)).alias("n_leaves"), long(F.lit(0)).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), F.sha2(F.col("member").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return shared.select(*NODE).unionAll(chain.select(*NODE))


def plain(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are; what ``nodes`` returns."""
    turns = ordered(conversations)
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("len"))
    return nodes(turns.join(lengths, "conv_id").select("conv_id", "len", "pos", "key", "bytes"))


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """The trie of conversations with spliced beginnings (``spliced``)."""
    return nodes(spliced(ordered(conversations), group, most))
