"""Tokens of documents to postings, many documents at once.  Shipped to executors by value."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens that are grouped at once; a longer text by itself.
MOST_TOKENS = 2_000_000


def grouped(batches, bounds=None):
    """Rows of (key, field, base, joined) to rows of (term, field, key, tf, length, positions), and part with ``bounds``."""
    for batch in batches:
        base, joined = batch.column("base"), batch.column("joined")
        sizes = pc.add(pc.list_value_length(joined), 1).to_numpy(zero_copy_only=False).astype("int64")
        np.add.at(sizes, pc.list_parent_indices(base).to_numpy(), pc.list_value_length(base.flatten()).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // MOST_TOKENS)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if end > start:
                yield _at_once(batch.slice(start, end - start), bounds)


def _at_once(batch, bounds):
    base, joined = batch.column("base"), batch.column("joined")
    values = base.flatten()
    document, inner = pc.list_parent_indices(base).to_numpy(), values.value_lengths().to_numpy(zero_copy_only=False)
    value = np.arange(len(values)) - np.repeat(_starts(base), base.value_lengths().to_numpy(zero_copy_only=False))
    at = np.arange(inner.sum()) - np.repeat(_starts(values), inner) + np.repeat(value << 32, inner)
    document = np.concatenate([np.repeat(document, inner), pc.list_parent_indices(joined).to_numpy()])
    at = np.concatenate([at, np.full(len(document) - len(at), -1)])
    words = pa.concat_arrays([values.flatten(), joined.flatten()]).dictionary_encode()
    group = document * max(len(words.dictionary), 1) + words.indices.to_numpy()
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    mine, at = document[order][first], at[order]
    placed = np.concatenate([[0], np.cumsum(at >= 0)])[[*first, len(at)]]
    code, key = words.indices.to_numpy()[order[first]], batch.column("key").take(pa.array(mine))
    columns = {
        "term": words.dictionary.take(pa.array(code)),
        "field": batch.column("field").take(pa.array(mine)),
        "key": key,
        "tf": pa.array(np.diff([*first, len(at)])),
        "length": pa.array(np.bincount(document, minlength=batch.num_rows)[mine]),
        "positions": pa.ListArray.from_arrays(pa.array(placed, pa.int32()), pa.array(at[at >= 0])),
    }
    if bounds is not None:
        columns["part"] = pa.array(_part(words.dictionary, code, key, bounds), pa.int32())
    return pa.RecordBatch.from_pydict(columns)


def _part(terms, code, key, bounds):
    """How many bounds (term, key) lie below each row; keys are looked at for terms that bounds have."""
    ends = np.array(bounds[0], object)
    words = np.array(terms.to_pylist(), object)
    low, high = (np.searchsorted(ends, words, side) for side in ("left", "right"))
    out = low[code]
    often = np.flatnonzero((high > low)[code])
    often = often[np.argsort(code[often], kind="stable")]
    for rows in np.split(often, np.flatnonzero(np.diff(code[often])) + 1):
        if len(rows):
            c = code[rows[0]]
            keys = key.take(pa.array(rows)).drop_null().to_numpy(zero_copy_only=False)
            if len(keys) == len(rows):
                out[rows] += np.searchsorted(np.array(bounds[1][low[c] : high[c]]), keys)
    return out


def _starts(lists):
    """Where each list begins among the values of all."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.cumsum(sizes) - sizes
