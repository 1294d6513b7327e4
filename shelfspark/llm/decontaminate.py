"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

For every benchmark item, all windows of a document with as many words as the item are compared with it (the
whole document, if it is shorter).  A fingerprint is a 64-bit SimHash of the benchmark's shingles that a window or an item has,
each once, weighted by how rare it is in the benchmark.  Fingerprints are cut into ``blocks``; by the pigeonhole principle
two within ``radius`` bits agree up to radius // blocks bits in one block, and the items are indexed under all such
values, so every item within the radius is found.  What is found is checked exactly: the summed weight of the item's
shingles that the window has, over that of all its shingles, has to reach ``similarity``.

Windows that hold the same of the benchmark's shingles have one fingerprint, made once.  A window with 0.8 of an item's weight and
nothing else of the benchmark differs from it in 9.4 of 64 bits on average, with a standard deviation of 2.8; the radius of 23 lies
almost five of these beyond.  README has the recall measured against all windows.

A window without any of the benchmark's shingles has similarity 0, so such windows are passed over before
fingerprinting, and so are items of which the whole document has no shingle; this loses nothing.  Benchmarks beyond ``items``
items are searched in blocks, one pass each; what a pass sends to the executors is bounded by ``items`` and ``item_words``.  The
shingles found in the documents that are worked on together, of about 50,000 words or one longer text, take about 1 KB each.

Null or empty texts match nothing, nor do items with a null id, or null, empty or blank text.  Items of fewer
words than a shingle have their whole sequence as one.  Rows that repeat a ``doc_id`` are searched each; equal items
match each.  Extra columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels


@dataclass(frozen=True)
class Search:
    words: int = 5
    similarity: float = 0.8
    radius: int = 23
    blocks: int = 8
    items: int = 10_000
    item_words: int = 200_000

    def __post_init__(self):
        if 64 % self.blocks or 64 // self.blocks > 16 or not 0 <= self.radius < 64:
            raise ValueError("blocks must be 4, 8, 16, 32 or 64, and radius below 64")


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of ``bits`` bits that have up to ``most`` bits set."""
    return np.array([sum(1 << p for p in places) for n in range(most + 1) for places in combinations(range(bits), n)], np.uint64)


class Index:
    """A block of items: their shingles with weights, fingerprints, and for each length the multi-index."""

    def __init__(self, ids: list, texts: list[str], how: Search):
        words = kernels.Words(pa.array(texts, pa.string()))
        self.how, self.ids, self.size = how, ids, words.counts
        self.print, self.kinds = np.zeros(len(ids), np.uint64), {}
        for k in sorted({int(min(how.words, m)) for m in self.size}):
            found, bound = kernels.distinct(*kernels.shingles(words, k))
            every, m = np.unique(found, return_counts=True)
            weight = np.log1p(len(ids) / m)
            signed = _signed(every, weight)
            own, holder = {}, []
            for i in np.flatnonzero(np.minimum(how.words, self.size) == k):
                at = np.searchsorted(every, found[bound[i] : bound[i + 1]])
                own[int(i)] = (every[at], weight[at])
                self.print[i] = _prints(signed[at].sum(0, dtype=np.int32)[None])[0]
                holder.append(np.stack([at, np.full(len(at), i)]))
            at, holder = np.concatenate(holder, 1)
            order = np.argsort(at, kind="stable")
            mine = np.unique(at)  # shingles of items of this kind; others of the same length may come from longer items
            self.kinds[k] = (every[mine], signed[mine], own, (every[at[order]], holder[order]))
        bits = 64 // how.blocks
        self.lengths, masks = {}, flips(bits, how.radius // how.blocks)
        for length in np.unique(self.size):
            items = np.flatnonzero(self.size == length)
            tables = []
            for b in range(how.blocks):
                own = (self.print[items] >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)
                value = (own[:, None] ^ masks).ravel().astype(np.int64)
                order = np.argsort(value, kind="stable")
                start = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << bits))])
                tables.append((start, np.repeat(items.astype(np.int32), len(masks))[order]))
            self.lengths[int(length)] = tables

    def near(self, print_: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) for all items of ``length`` words within the radius."""
        bits, found = 64 // self.how.blocks, []
        for b, (start, item) in enumerate(self.lengths[length]):
            own = ((print_ >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            rows = np.flatnonzero(start[own + 1] > start[own])
            lo = start[own[rows]]
            n = start[own[rows] + 1] - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(rows, n), item[at]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        far = np.bitwise_count(print_[pairs[:, 0]] ^ self.print[pairs[:, 1]])
        keep = far <= self.how.radius
        return pairs[keep, 0], pairs[keep, 1], far[keep]

    def search(self, column: pa.Array) -> Iterator[tuple]:
        """(row, item, first word, words, distance, similarity) of the best window for each row and item found."""
        words = kernels.Words(column)
        for k, (every, signed, own, postings) in self.kinds.items():
            shingle, sbound = kernels.shingles(words, k)
            at = np.minimum(np.searchsorted(every, shingle), len(every) - 1)
            hit = np.flatnonzero(every[at] == shingle)
            if not len(hit):
                continue
            rows = np.searchsorted(sbound, hit, "right") - 1
            used = np.unique(rows)
            for group in np.array_split(used, max(1, int(words.counts[used].sum()) // 50_000)):
                mine = np.isin(rows, group)
                yield from self._group(words, shingle, sbound, k, own, postings, group, hit[mine], signed[at[hit[mine]]])

    def _group(self, words, shingle, sbound, k, own, postings, rows, hit, signed):
        """The same for some rows of which each has a shingle of the benchmark; ``signed``: what each such place adds to a fingerprint."""
        n = words.counts[rows]
        local = np.searchsorted(rows, np.searchsorted(sbound, hit, "right") - 1)
        place, value = hit - sbound[rows[local]], shingle[hit]
        order = np.lexsort((place, value, local))
        again = (local[order][1:] == local[order][:-1]) & (value[order][1:] == value[order][:-1])
        before = np.full(len(hit), -1)  # where the same shingle stands last; a window counts it where it stands first
        before[order[1:][again]] = place[order[:-1][again]]
        shared, width = self._shared(value, local, postings), int(n.max()) + 2
        best: dict[tuple[int, int], tuple] = {}
        for length in sorted({int(self.size[i]) for i in own}):
            m = np.minimum(length, n[local])
            low = np.maximum(np.maximum(before + 1, place - (m - k)), 0)
            high = np.minimum(place, n[local] - m) + 1
            held = np.flatnonzero(low < high)
            if not len(held):
                continue
            # each shingle enters the sum at the first window that counts it and leaves it behind the last
            edge = np.concatenate([(local * width + low)[held], (local * width + high)[held]])
            order = np.argsort(edge, kind="stable")
            at, first = np.unique(edge[order], return_index=True)
            change = np.concatenate([signed[held], -signed[held]])[order]
            total = np.cumsum(np.add.reduceat(change, first, axis=0), axis=0, dtype=np.int32)
            many = np.cumsum(np.add.reduceat(np.where(order < len(held), 1, -1), first))
            full = np.flatnonzero(many > 0)
            window, item, far = self.near(_prints(total[full]), length)
            of, start = np.divmod(at[full], width)
            pair = of[window] * len(self.ids) + item
            keep = shared[np.minimum(np.searchsorted(shared, pair), len(shared) - 1)] == pair
            for w, i, d in zip(window[keep].tolist(), item[keep].tolist(), far[keep].tolist(), strict=True):
                r, begin = int(rows[of[w]]), int(start[w])
                size = int(min(length, n[of[w]]))
                a = int(sbound[r]) + begin
                theirs, weights = own[i]
                share = float(weights[np.isin(theirs, shingle[a : a + size - k + 1])].sum() / weights.sum())
                if share + 1e-12 >= self.how.similarity and (-share, d, begin) < best.get((r, i), (1, 0, 0))[:3]:
                    best[r, i] = (-share, d, begin, size)
        for (r, i), (share, d, begin, size) in best.items():
            yield r, i, begin, size, d, -share

    def _shared(self, shingle: np.ndarray, local: np.ndarray, postings) -> np.ndarray:
        """(place in the group, item) as one number, ascending, for all that have a shingle in common."""
        every, holder = postings
        pair = np.unique(np.stack([local.astype(np.uint64), shingle]), axis=1)
        row, s = pair[0].astype(np.int64), pair[1]
        found, at = [np.zeros(0, np.int64)], 0
        lo = np.searchsorted(every, s, "left")
        many = np.searchsorted(every, s, "right") - lo
        done = np.concatenate([[0], np.cumsum(many)])
        while at < len(row):  # about so many postings at a time
            to = max(at + 1, int(np.searchsorted(done, done[at] + 1_000_000, "right")) - 1)
            m = many[at:to]
            place = np.repeat(lo[at:to] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            found.append(np.unique(np.repeat(row[at:to], m) * len(self.ids) + holder[place]))
            at = to
        return np.unique(np.concatenate(found))


def _signed(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What each hash adds to the 64 sums of a fingerprint."""
    sign = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    return sign * np.maximum(1, np.round(16 * weight)).astype(np.int32)[:, None]


def _prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def item_blocks(benchmark: DataFrame, how: Search) -> Iterator[tuple[list, list[str]]]:
    """Blocks of items in order, each of bounded count and length."""
    ids, texts, words = [], [], 0
    rows = benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        n = len(row.text.encode().split())
        if n and ids and (len(ids) >= how.items or words + n > how.item_words):
            yield ids, texts
            ids, texts, words = [], [], 0
        if n:
            ids.append(row.item_id)
            texts.append(row.text)
            words += n
    if ids:
        yield ids, texts


def _search(ids: list, texts: list[str], how: Search, item_kind: pa.DataType):
    key = uuid.uuid4().hex  # an index is made once in each process, not once in each task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                index = kernels.latest("indexes", key, lambda: Index(ids, texts, how), 2)
                found = sorted(index.search(part.column("text")))
                if found:
                    row, item, start, size, far, value = zip(*found, strict=True)
                    yield pa.record_batch(
                        {
                            "doc_id": part.column("doc_id").take(pa.array(row, pa.int64())),
                            "item_id": pa.array([ids[i] for i in item], item_kind),
                            "start_word": pa.array(start, pa.int64()),
                            "n_words": pa.array(size, pa.int64()),
                            "distance": pa.array(far, pa.int64()),
                            "similarity": pa.array(value, pa.float64()),
                        }
                    )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance, similarity: for each document and item that it contains, the best window."""
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select("doc_id", "text")
    kind, item = dict(docs.dtypes)["doc_id"], benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item.simpleString()}, start_word long, n_words long, distance long, similarity double"
    out = None
    for ids, texts in item_blocks(benchmark, how):
        part = docs.mapInArrow(_search(ids, texts, how, to_arrow_type(item)), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item; columns as they are."""
    out = docs
    for ids, texts in item_blocks(benchmark, how):
        out = out.mapInArrow(_free(ids, texts, how), docs.schema)
    return out


def _free(ids: list, texts: list[str], how: Search):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                index = kernels.latest("indexes", key, lambda: Index(ids, texts, how), 2)
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, *_ in index.search(part.column("text"))]] = False
                yield part.filter(pa.array(keep))

    return run
