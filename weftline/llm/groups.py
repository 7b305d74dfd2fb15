"""Contiguous groups in a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups only, with the positions where groups begin and the length at the end.

    The rows come sorted by ``keys`` (columns of longs without nulls). A group that spans batches is held back until
    its last row is there, so memory is a batch and the largest group.
    """
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        n = t.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        if held:
            last, first = held[-1], b.slice(0, 1)
            if all(b.column(k)[-1].as_py() == last.column(k)[-1].as_py() == first.column(k)[0].as_py() for k in (b.schema.get_field_index(x) for x in keys)):
                held.append(b)
                continue
        t = pa.Table.from_batches([*held, b])
        begins = cut(t)
        if len(begins) > 1:
            yield t.slice(0, int(begins[-1])), begins
        held = t.slice(int(begins[-1])).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.append(cut(t), t.num_rows)
