"""Arrow batches of lists in numpy: cut to bounded parts, flattened with row and place."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Elements of lists that are worked on at once, unless a single row has more.
AT_ONCE = 1 << 20


def slices(batch: pa.RecordBatch, lists: Iterable[int]) -> Iterator[pa.RecordBatch]:
    """``batch`` cut between rows, so that the columns ``lists`` have ``AT_ONCE`` elements a part."""
    if not batch.num_rows:
        return
    sizes = [pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in lists]
    part = np.cumsum(sum(sizes)) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, place and value of each element of ``lists``; null lists have none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists), dtype=np.int64), sizes)
    at = np.arange(len(row), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, at.astype(np.int32), lists.flatten()
