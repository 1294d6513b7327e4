"""Token ids of documents in binary files: byte-level BPE ids in patched frame-of-reference containers.

``write`` deals documents by ``doc_id`` range, sorts each part, encodes it and writes files of about ``segment`` ids, whole
documents each.  A file holds two patched frame-of-reference containers, of ids and of their numbers by document, and the
``doc_id`` column as an Arrow stream; it can be read alone.  What ``write`` returns is the stored list of the files: (shard,
segment, inside, n_tokens, file), in order by (shard, segment).  A task names its files by its attempt, and only the list
of the attempt that Spark commits counts, so lost executors and repeated tasks leave no wrong file in the list.  ``digests``
and ``read`` read the files back.  Files are opened by Arrow's file systems from the URI in ``spark.checkpoint.dir``.

Encoding is exact and fast because a byte-level pre-tokenizer never joins text across a blank that follows a
printable character: texts are cut there, pieces of equal bytes are encoded once by the library, and a worker
remembers pieces it has met, at most ``remember`` and those of one slice (forgetting costs time only).

Null or empty texts have the end id alone.  A null ``doc_id`` comes first.  Rows that repeat a ``doc_id`` are
written one after another, by a hash of the text, by which they are dealt too.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels, pfor, store


HEAD = "<4sQQQ"
LIST = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.string())])
LETTER = np.zeros(256, bool)
ONE_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
LETTER[65:91] = LETTER[97:123] = True


@dataclass(frozen=True)
class TokenFiles:
    """``tokenizer``: path of a byte-level BPE file of the tokenizers library, the same on every machine."""

    tokenizer: str
    end_id: int = 2
    block: int = 256
    percentile: float = 95.0
    segment: int = 1 << 20
    remember: int = 400_000


class Encoder:
    """Ids of whole texts, one library call for each new piece."""

    def __init__(self, path: str, remember: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.remember = remember
        self._forget()
        plain = bytes([*range(33, 127), *range(161, 173), *range(174, 256)])
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        if self.library.normalizer is not None or not str(self.library.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False"):
            raise ValueError("texts are cut by the rules of a byte-level pre-tokenizer without a prefix space")
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = [s.encode() for s in special]

    def _forget(self):
        # pieces met, by their bytes, and where each one's ids are
        self.known: dict[bytes, int] = {}
        self.first, self.many, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str, remember: int) -> Encoder:
        """This process's encoder, kept from task to task."""
        return kernels.once(f"encoder {remember} {path}", lambda: cls(path, remember))

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Piece starts, at places where pre-tokens surely end whatever stands around them.

        Before a blank after a visible character; after a letter before a visible ASCII character that is
        none; behind a single blank other than a space.  Only characters of one byte, and of two bytes in
        U+00C0-U+00FF, are taken for letters; unsure places are simply not cut.
        """
        t = kernels.tables()
        blank, letter = t["space"][data], LETTER[data]
        visible = (data > 32) & (data < 127)
        odd = visible & ~letter
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        visible[1:] |= (data[1:] >= 128) & (data[1:] < 192) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (blank[1:] & visible[:-1]) | (letter[:-1] & odd[1:])
        first = offsets[:-1][offsets[1:] > offsets[:-1]]
        cut[first] = True
        # behind a single blank, but not before one beyond ASCII, which would make them one run
        cut[2:-1] |= cut[1:-2] & blank[1:-1] & (data[1:-1] != 32) & ((data[2:] > 32) & (data[2:] < 127) | (data[2:] == 0xC3))
        cut[first] = True
        return np.flatnonzero(cut[:-1])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bound): ids of row i are ``ids[bound[i]:bound[i + 1]]``."""
        data, offsets = kernels.utf8(column)
        start = self.cuts(data, offsets)
        if self.special and any(s in data.tobytes() for s in self.special):
            # a special token's own string is one id for the library, so such texts are not cut
            whole = np.array([any(s in data[a:b].tobytes() for s in self.special) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            row = np.searchsorted(offsets, start, "right") - 1
            keep = ~whole[row] | (start == offsets[row])
            start = start[keep]
        # pieces lie one behind the other and cover all bytes
        bound = pa.py_buffer(np.append(start, len(data)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, bound, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        at = self._learn(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        first, many = self.first[at], self.many[at]
        ends = np.cumsum(many)
        ids = self.ids[np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(start, offsets)]

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Places of the pieces among those known."""
        if len(self.known) > self.remember:
            self._forget()
        get, base = self.known.get, len(self.many)
        at = np.fromiter((get(piece, -1) for piece in pieces), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        ids, many, added = [], [], [pieces[j] for j in new.tolist()]
        model, encode, letters, one = self.library.model.tokenize, self.library.encode, self.letters, ONE_WORD.fullmatch
        for piece in added:
            if one(piece):  # one pre-token: the model's own call, in its byte alphabet
                got = [x.id for x in model(piece.decode("latin-1").translate(letters))]
            else:
                got = encode(piece.decode(), add_special_tokens=False).ids
            many.append(len(got))
            ids += got
        at[new] = base + np.arange(len(new))
        self.known.update(zip(added, range(base, base + len(added)), strict=True))
        first = len(self.ids) + np.concatenate([[0], np.cumsum(many, dtype=np.int64)])[:-1]
        self.ids, self.first, self.many = np.concatenate([self.ids, np.array(ids, np.uint32)]), np.concatenate([self.first, first]), np.concatenate([self.many, np.array(many, np.int64)])
        return at


def file_bytes(ids: np.ndarray, sizes: np.ndarray, doc_ids: pa.Array, how: TokenFiles) -> bytes:
    """Layout: magic "PFD1", u64 lengths of the three parts; container of ids, container of sizes, Arrow stream of ``doc_id``."""
    table = pa.record_batch({"doc_id": doc_ids})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_batch(table)
    parts = [pfor.pack(ids, how.block, how.percentile), pfor.pack(sizes, how.block, how.percentile), sink.getvalue().to_pybytes()]
    return b"".join([struct.pack(HEAD, b"PFD1", *map(len, parts)), *parts])


def file_parts(data: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, sizes, doc_ids) of a file."""
    magic, a, b, c = struct.unpack_from(HEAD, data)
    if magic != b"PFD1":
        raise ValueError("not a file of token ids")
    view, at = memoryview(data), struct.calcsize(HEAD)
    table = pa.ipc.open_stream(view[at + a + b : at + a + b + c]).read_all()
    return pfor.unpack(view[at : at + a]), pfor.unpack(view[at + a : at + a + b]).astype(np.int64), pa.concat_arrays(table.column("doc_id").chunks)


def _encode_sorted(how: TokenFiles, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, encoder, segment = TaskContext.get(), Encoder.of(how.tokenizer, how.remember), 0
        shard, system, root = task.partitionId(), *fs.FileSystem.from_uri(folder)
        doc_ids, sizes, ids, held, inside = [], [], [], 0, 0

        def flush():
            name = f"{shard:08d}-{segment:06d}-{task.taskAttemptId()}.pfd"
            if not segment:
                system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(doc_ids), how))
            row = {"shard": shard, "segment": segment, "inside": inside, "n_tokens": held, "file": f"{folder}/{name}"}
            return pa.RecordBatch.from_pylist([row], LIST)

        for batch in batches:
            for part in kernels.slices(batch, "text"):
                found, bound = encoder.encode(part.column("text"))
                # the end id goes behind each document
                out = np.insert(found, bound[1:], how.end_id).astype(np.uint32)
                ends, at = bound[1:] + np.arange(1, len(bound)), 0
                while at < part.num_rows:
                    done = int(ends[at - 1]) if at else 0
                    to = min(part.num_rows, int(np.searchsorted(ends, done + how.segment - held)) + 1)
                    doc_ids.append(part.column("doc_id").slice(at, to - at))
                    sizes.append(np.diff(ends[at:to], prepend=done))
                    ids.append(out[done : int(ends[to - 1])])
                    at, held = to, held + len(ids[-1])
                    if held >= how.segment:
                        yield flush()
                        segment, inside = segment + 1, inside + held
                        doc_ids, sizes, ids, held = [], [], [], 0
        if doc_ids:
            yield flush()

    return run


def write(docs: DataFrame, how: TokenFiles) -> DataFrame:
    """The stored list of files, in ascending ``doc_id`` order by (shard, segment)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    folder = store.fresh_path(docs.sparkSession, "token-files")
    store.MADE.add(folder)
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return store.stored(dealt.mapInArrow(_encode_sorted(how, folder), "shard int, segment int, inside long, n_tokens long, file string"), "token-list")


def with_starts(files: DataFrame) -> DataFrame:
    """``files`` with ``before``: ids of all files before each.

    A file knows the ids before it in its shard; sums of whole shards, of which there are as many as the session has
    shuffle partitions at most, are ordered as a whole and sent to every task."""
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    shards = shards.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("shard_before"))
    return files.join(F.broadcast(shards), "shard").withColumn("before", F.col("shard_before") + F.col("inside")).drop("shard_before")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids before, ids, sizes, doc_ids) of each file listed."""
    from pyarrow import fs

    for batch in batches:
        for before, uri in zip(batch.column("before").to_pylist(), batch.column("file").to_pylist(), strict=True):
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_stream(path) as stream:
                yield before, *file_parts(stream.read())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for before, ids, sizes, doc_ids in opened(batches):
        ends = np.cumsum(sizes)
        view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        yield pa.record_batch(
            {
                "doc_id": doc_ids,
                "start": pa.array(before + ends - sizes, pa.int64()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(view[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64()),
            }
        )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, ids, sizes, doc_ids in opened(batches):
        bound = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.record_batch({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(bound), pa.array(ids.astype(np.int32)))})


def spread(files: DataFrame) -> DataFrame:
    """The list dealt out, a file for each task as long as there are not too many."""
    files = with_starts(files)
    return files.repartition(max(1, min(files.count(), 100_000)))


def digests(files: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id (of Spark type ``kind``), start, n_tokens, ids_crc32 of each document, read back from the files."""
    return spread(files).mapInArrow(_digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read(files: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id (of Spark type ``kind``), ids (with the end id) of each document."""
    return spread(files).mapInArrow(_decode, f"doc_id {kind}, ids array<int>")


def open_list(spark: SparkSession, path: str) -> DataFrame:
    """A stored list of files."""
    return spark.read.parquet(path)
