"""Reading sorted Arrow batches group by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The stretches of rows whose first ``keys`` columns (without nulls) are equal, in the order of the stream."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if open_ and any(open_[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(open_)
            open_ = []
        changes = None
        for k in range(keys):
            column = batch.column(k)
            differs = pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1))
            changes = differs if changes is None else pc.or_(changes, differs)
        start = 0
        for cut in changes.to_numpy(zero_copy_only=False).nonzero()[0].tolist():
            open_.append(batch.slice(start, cut + 1 - start))
            yield pa.Table.from_batches(open_)
            open_, start = [], cut + 1
        open_.append(batch.slice(start))
    if open_:
        yield pa.Table.from_batches(open_)
