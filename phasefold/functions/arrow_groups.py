"""Streaming over Arrow batches whose rows arrive sorted by a group key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def group_starts(columns: list[pa.Array]) -> np.ndarray:
    """Positions at which any of the key columns differs from the row before."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            c = c.dictionary_encode().indices
        v = c.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold only whole groups; the last, unfinished group waits for more rows.

    Rows must come sorted by ``keys`` and no key may be null. One group must fit
    in memory, so callers bound their groups before.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = group_starts([batch.column(k) for k in keys])
        same = held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        cut = int(starts[-1])
        if same and cut == 0:
            held.append(batch)
            continue
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
