"""Streams of Arrow batches: sorted ones cut where their keys change, and tasks that leave no memory behind."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa


def whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int, most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of about ``rows`` rows from batches sorted by ``keys``, cut between keys.

    A key of more than ``most`` rows is cut too, and False given where it goes on in the next table.
    """
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        columns = [table.column(key).to_numpy() for key in keys]
        other = np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0))
        start = int(other[-1]) + 1 if len(other) else 0
        if start:
            yield table.slice(0, start), True
        waiting, n = table.slice(start).to_batches(), table.num_rows - start
        if most is not None and n >= most:
            yield table.slice(start), False
            waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks(), True


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; what Arrow has freed in a task goes back to the machine, as Spark keeps its worker, and an executor's memory holds both."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            pa.system_memory_pool().release_unused()

    return task
