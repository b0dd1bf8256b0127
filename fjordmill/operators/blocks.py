"""Whole runs of equal keys from Arrow batches that are sorted by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(batches, keys: list[str], enough: int = 1 << 13):
    """Tables of whole runs of equal keys from batches sorted by them, several runs at a time, and their bounds."""
    held, rows = [], 0

    def cut(t: pa.Table):
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            d = c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) and not c.null_count else c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= d[1:] != d[:-1]
        return np.concatenate([[0], np.nonzero(new)[0], [t.num_rows]])

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows < enough:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        at = cut(t)
        if len(at) > 2:
            yield t.slice(0, at[-2]), at[:-1]
            t = t.slice(at[-2]).combine_chunks()
        held, rows = t.to_batches(), t.num_rows
        enough = max(enough, 2 * rows)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, cut(t)


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
