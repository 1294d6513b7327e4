"""Hidden Markov language model: Baum-Welch counts from all partitions, exact forward likelihoods.

Tokens are the words of a text, A-Z lower-cased, and one end.  The model's symbols are the ``frequent`` most frequent
words of the training texts, the end, and ``classes`` classes of all other words by their last two bytes.  A word of
a class has probability (c + 1) / (N + V + 1) within it, with its count c and the class's tokens N and
distinct words V, so the model is a distribution over known words and leaves a share to unknown ones.

Every round of training sees all training texts, whole.  Forward and backward passes run over many texts at once, the
longest first, with ``held`` tokens at a time in memory: of a longer text only the states at the edges of its parts are kept, and
a part's are computed again on the way back.  Expected counts are summed by task, then by index, in the engine.

Counts of words outside the frequent ones meet the texts through packed postings, by cell of the word's hash: a
cell never holds a word with more than its share of the corpus, since frequent words are looked up in place.

A null text is empty and has the end alone.  A null ``doc_id`` is never learnt from.  Rows that repeat a
``doc_id`` are scored each.  Extra columns are ignored.  With nothing to learn from, scores are those of
uniform tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, linear, store


@dataclass(frozen=True)
class Model:
    states: int = 8
    frequent: int = 8192
    classes: int = 512
    rounds: int = 5
    held: int = 1 << 20
    prior: float = 500.0
    seed: int = 3

    @property
    def symbols(self) -> int:
        """Frequent words, then classes, then the end."""
        return self.frequent + self.classes + 1


def word_class(words: kernels.Words, classes: int) -> np.ndarray:
    low = words.data[words.end - 1].astype(np.uint64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.uint64)
    return (kernels.mix(low * np.uint64(256) + before + np.uint64(1)) % np.uint64(classes)).astype(np.int32)


def _counts(how: Model):
    classes = how.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged():
            h, n, c = (np.concatenate(x) for x in zip(*held, strict=True))
            one, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return one, np.bincount(inverse, n, len(one)).astype(np.int64), c[first]

        def rows(h, n, c):
            return pa.record_batch({"h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64()), "class": pa.array(c, pa.int32())})

        for batch in batches:
            for part in kernels.slices(batch, "text"):
                words = kernels.Words(part.column("text"))
                one, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                held.append((one, n, word_class(words, classes)[first]))
                if len(held) >= 8:
                    held[:] = [merged()]
                    if len(held[0][0]) > 2_000_000:
                        yield rows(*held.pop())
        if held:
            yield rows(*merged())

    return run


def _postings(how: Model, cells: int, words_: np.ndarray, logs: np.ndarray, class_logs: np.ndarray, end_log: float):
    """Rows of two kinds: 0, one for each text, with its symbols; 1, for each chunk of texts and cell, its words that are not frequent.

    ``words_``: hashes of the frequent words, ascending; ``logs`` of their counts plus one; ``class_logs`` of N + V + 1."""
    classes, frequent = how.classes, how.frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in kernels.slices(batch, "text", 4 * kernels.SLICE):
                words, rows = kernels.Words(part.column("text")), part.num_rows
                row, counts = words.row(), words.counts
                at = np.minimum(np.searchsorted(words_, words.hash), max(len(words_) - 1, 0))
                known = words_[at] == words.hash if len(words_) else np.zeros(len(words.hash), bool)
                group = word_class(words, classes)
                symbol = np.where(known, at, frequent + group).astype(np.uint16)
                bound = words.bound + np.arange(rows + 1)
                sequence = np.full(bound[-1], frequent + classes, np.uint16)
                sequence[np.arange(len(symbol)) + row] = symbol
                in_place = np.bincount(row[known], logs[at[known]], rows) if len(words_) else np.zeros(rows)
                by_class = np.bincount(row[~known], class_logs[group[~known]], rows)
                none = pa.nulls(rows, pa.binary())
                yield pa.record_batch(
                    {
                        "kind": pa.array(np.zeros(rows, np.int32)),
                        "cell": pa.array(np.zeros(rows, np.int32)),
                        "chunk": pa.array(np.full(rows, chunk)),
                        "at": pa.array(np.arange(rows, dtype=np.int32)),
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "train": part.column("train"),
                        "n_tokens": pa.array(counts + 1, pa.int64()),
                        "n_known": pa.array(np.bincount(row[known], minlength=rows) + (end_log > 0), pa.int64()),
                        "base": pa.array(in_place + end_log),
                        "classed": pa.array(by_class),
                        "symbols": kernels.binary(sequence, bound),
                        "words": none,
                        "docs": none,
                        "times": none,
                    }
                )
                h, r = words.hash[~known], row[~known]
                order = np.lexsort((r, h))
                h, r = h[order], r[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(h)))
                h, r = h[first], r[first].astype(np.int32)
                cell = ((h >> np.uint64(32)) % np.uint64(cells)).astype(np.int32)
                order = np.argsort(cell, kind="stable")
                h, r, times, cell = h[order], r[order], times[order].astype(np.int32), cell[order]
                here, start = np.unique(cell, return_index=True)
                edge, m = np.append(start, len(h)), len(here)
                if m:
                    gap = {"held_out": pa.bool_(), "train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "classed": pa.float64(), "symbols": pa.binary()}
                    yield pa.record_batch(
                        {"kind": pa.array(np.ones(m, np.int32)), "cell": pa.array(here), "chunk": pa.array(np.full(m, chunk)), "at": pa.array(np.zeros(m, np.int32)), "doc_id": pa.nulls(m, part.column("doc_id").type)}
                        | {k: pa.nulls(m, v) for k, v in gap.items()}
                        | {"words": kernels.binary(h, edge), "docs": kernels.binary(r, edge), "times": kernels.binary(times, edge)}
                    )
                chunk += 1

    return run


def _looked_up(postings: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """For a cell: each chunk's texts with the sum of log10(c + 1) and how many of their words are known."""
    known, n = vocabulary.column("h").to_numpy().view(np.uint64), vocabulary.column("n").to_numpy()
    order = np.argsort(known)
    known, logs = known[order], np.log10(n[order] + 1.0)
    out = []
    for chunk, w, d, t in zip(*(postings.column(c).to_pylist() for c in ("chunk", "words", "docs", "times")), strict=True):
        h, r, times = np.frombuffer(w, np.uint64), np.frombuffer(d, np.int32), np.frombuffer(t, np.int32)
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        hit = known[at] == h if len(known) else np.zeros(len(h), bool)
        r, times, found = r[hit], times[hit], logs[at[hit]]
        rows, inverse = np.unique(r, return_inverse=True)
        out.append(
            {
                "chunk": chunk,
                "docs": rows.astype(np.int32).tobytes(),
                "known": np.bincount(inverse, times, len(rows)).astype(np.int32).tobytes(),
                "logs": np.bincount(inverse, times * found, len(rows)).tobytes(),
            }
        )
    return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("known", pa.binary()), ("logs", pa.binary())]))


def _summed(parts: pa.Table) -> pa.Table:
    """For a chunk: the sums of its texts over all cells."""
    r, k, s = (np.concatenate([np.frombuffer(x, t) for x in parts.column(c).to_pylist()]) for c, t in (("docs", np.int32), ("known", np.int32), ("logs", np.float64)))
    rows, inverse = np.unique(r, return_inverse=True)
    return pa.table(
        {
            "chunk": pa.array(np.full(len(rows), parts.column("chunk")[0].as_py()), pa.int64()),
            "at": pa.array(rows, pa.int32()),
            "more_known": pa.array(np.bincount(inverse, k, len(rows)).astype(np.int64)),
            "more": pa.array(np.bincount(inverse, s, len(rows))),
        }
    )


def forward(flat: np.ndarray, bound: np.ndarray, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence ``flat[bound[i]:bound[i + 1]]``; ``emit`` has a row for each symbol."""
    n = np.diff(bound)
    order = np.argsort(-n, kind="stable")
    at, sizes = bound[:-1][order], n[order]
    out, alpha = np.zeros(len(n)), np.tile(start, (len(n), 1))
    live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
    for t, m in enumerate(live):
        a = alpha[:m] @ step if t else alpha[:m]
        a = a * emit[flat[at[:m] + t]]
        total = a.sum(axis=1)
        np.divide(a, total[:, None], out=alpha[:m])
        out[:m] += np.log(total)
    back = np.empty(len(n))
    back[order] = out
    return back


def expected(flat: np.ndarray, bound: np.ndarray, start, step, emit, held: int = 1 << 20) -> np.ndarray:
    """Baum-Welch counts of the whole sequences as one vector: starts, steps, emissions."""
    states, symbols = len(start), len(emit)
    starts, steps, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols))
    emit, ahead_of = np.ascontiguousarray(emit.T), np.ascontiguousarray(step.T)
    n = np.diff(bound)
    order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
    begins, sizes = bound[:-1][order], n[order]
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + held, "right")))
        begin, size, length, at = begins[at:to], sizes[at:to], int(sizes[at]), to
        # the sequences that reach t are the first live[t]; their tokens at t are off[t]:off[t + 1] of all
        live = np.searchsorted(-size, -np.arange(length), "left")
        off = np.concatenate([[0], np.cumsum(live)])
        cuts = [0]
        while cuts[-1] < length:
            cuts.append(min(length, max(cuts[-1] + 1, int(np.searchsorted(off, off[cuts[-1]] + held, "right")) - 1)))

        def ahead(low, high, alpha, obs, scale, last):
            """Scaled forward shares of the states at ``low:high``, into the arrays; returns the last."""
            for t in range(low, high):
                k, x = live[t], slice(off[t] - off[low], off[t + 1] - off[low])
                obs[x] = flat[begin[:k] + t]
                a = (ahead_of @ last[:, :k] if t else start[:, None]) * emit.take(obs[x], axis=1)
                a.sum(axis=0, out=scale[x])
                last = np.divide(a, scale[x], out=alpha[:, x])
            return last

        def room(low, high):
            m = off[high] - off[low]
            return np.empty((states, m), np.float32), np.empty(m, np.int64), np.empty(m, np.float32)

        entry = [None]
        for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):
            entry.append(ahead(low, high, *room(low, high), entry[-1]).copy())
        beta = np.ones((states, len(size)), np.float32)
        for low, high, last in zip(cuts[-2::-1], cuts[:0:-1], entry[::-1], strict=True):
            alpha, obs, scale = room(low, high)
            ahead(low, high, alpha, obs, scale, last)
            for t in range(high - 1, low - 1, -1):
                k, x = live[t], slice(off[t] - off[low], off[t + 1] - off[low])
                back = emit.take(obs[x], axis=1)
                back *= beta[:, :k]
                back /= scale[x]
                alpha[:, x] *= beta[:, :k]  # the states' shares of the symbol
                if t:
                    before = alpha[:, off[t - 1] - off[low] : off[t - 1] - off[low] + k] if t > low else last[:, :k]
                    steps += step * (before @ back.T)
                    beta[:, :k] = step @ back
                else:
                    starts += alpha[:, x].sum(axis=1)
            for j in range(states):
                emits[j] += np.bincount(obs, alpha[j], symbols)
    return np.concatenate([starts, steps.ravel(), emits.ravel()])


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("symbols")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint16)[offsets[0] // 2 : offsets[-1] // 2], (offsets - offsets[0]) // 2


def _expect(how: Model, tables: tuple):
    held = how.held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, step, emit = (x.astype(np.float32) for x in tables)
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + expected(*_sequences(batch), start, step, emit, held)
        if np.ndim(total):
            i = np.flatnonzero(total)
            yield pa.record_batch({"i": pa.array(i, pa.int64()), "v": pa.array(total[i])})

    return run


def train(texts: DataFrame, unigram: np.ndarray, how: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, step, emit by symbol) from the symbols of all training texts."""
    h, rng = how.states, np.random.default_rng(how.seed)
    p = (unigram + 1) / (unigram + 1).sum()
    step = np.full((h, h), 0.1 / max(h - 1, 1))
    np.fill_diagonal(step, 0.9 if h > 1 else 1.0)
    emit = p * rng.gamma(2.0, 0.5, (h, len(p)))
    tables = np.full(h, 1 / h), step, (emit / emit.sum(axis=1, keepdims=True)).T
    for _ in range(how.rounds):
        total = np.zeros(h + h * h + h * len(p))
        found = texts.select("symbols").mapInArrow(_expect(how, tables), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        total[found.column("i").to_numpy()] = found.column("v").to_numpy()
        starts, steps, emits = total[:h] + 1, total[h : h + h * h].reshape(h, h) + 0.1, total[h + h * h :].reshape(h, -1) + how.prior * p
        tables = starts / starts.sum(), steps / steps.sum(axis=1, keepdims=True), (emits / emits.sum(axis=1, keepdims=True)).T
    return tables


def _score(tables: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = forward(*_sequences(batch), *tables) / np.log(10)
            keep = [c for c in batch.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], names=[*keep, "hidden"])

    return run


def scores(docs: DataFrame, how: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, row for row of ``docs``."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    marked = docs.select("doc_id", "text", linear.held_out(F.col("doc_id"), 7, 2).alias("held_out")).withColumn("train", F.col("doc_id").isNotNull() & ~F.col("held_out"))
    vocabulary = marked.filter("train").select("text").mapInArrow(_counts(how), "h long, n long, class int").groupBy("h").agg(F.sum("n").alias("n"), F.first("class").alias("class"))
    vocabulary = store.stored(vocabulary, "vocabulary")
    ends = marked.filter("train").select("doc_id").count()
    by_class = {r["class"]: (r.n, r.v) for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count("h").alias("v")).collect()}
    top = sorted((r.h & (2**64 - 1), r.n, r["class"]) for r in vocabulary.orderBy(F.desc("n"), "h").limit(how.frequent).collect())
    tokens, distinct = sum(n for n, _ in by_class.values()) + ends, sum(v for _, v in by_class.values()) + (ends > 0)
    rest = np.array([by_class.get(c, (0, 0)) for c in range(how.classes)], np.float64)
    for _, n, c in top:
        rest[c] -= (n, 1)
    top_h, top_n = np.array([t[0] for t in top], np.uint64), np.array([t[1] for t in top], np.float64)
    cells = int(max(16, distinct // 60_000, tokens // 4_000_000))
    path = store.fresh_path(spark, "symbols")
    store.MADE.add(path)
    encoded = marked.mapInArrow(
        _postings(how, cells, top_h, np.log10(top_n + 1), np.log10(rest.sum(axis=1) + 1), float(np.log10(ends + 1))),
        f"kind int, cell int, chunk long, at int, doc_id {kind}, held_out boolean, train boolean, n_tokens long, n_known long, base double, classed double, symbols binary, words binary, docs binary, times binary",
    )
    encoded.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(encoded.schema).parquet(path)
    texts, postings = encoded.filter("kind = 0"), encoded.filter("kind = 1")

    unigram = np.zeros(how.symbols)
    unigram[: len(top_n)] = top_n
    unigram[how.frequent : how.frequent + how.classes], unigram[-1] = rest[:, 0], ends
    tables = train(texts.filter("train").select("symbols"), unigram, how)

    cell = F.pmod(F.shiftrightunsigned("h", 32), F.lit(cells)).cast("int")
    looked = postings.select("cell", "chunk", "words", "docs", "times").groupBy("cell").cogroup(vocabulary.select(cell.alias("cell"), "h", "n").groupBy("cell")).applyInArrow(_looked_up, "chunk long, docs binary, known binary, logs binary")
    more = looked.groupBy("chunk").applyInArrow(_summed, "chunk long, at int, more_known long, more double")
    columns = ["chunk", "at", "doc_id", "held_out", "n_tokens", "n_known", "base", "classed"]
    hidden = texts.select(*columns, "symbols").mapInArrow(_score(tables), f"chunk long, at int, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, classed double, hidden double")
    more_log = F.coalesce("more", F.lit(0.0))
    return hidden.join(more, ["chunk", "at"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more_log - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"),
        (F.col("hidden") + more_log - F.col("classed")).alias("score"),
    )
