"""Batches of bounded size for functions over Arrow and pandas batches, whose rows may be long or give many rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa

#: Letters in a batch of rows that leaves a task, and rows of a batch that are Python objects at one time.
BATCH_LETTERS, SLICE_ROWS = 2_000_000, 64


def in_batches(rows: Iterable[tuple], names: list[str], most: int = BATCH_LETTERS) -> Iterator[pd.DataFrame]:
    """Rows as frames that end with the row that brings their texts to so many letters; a row counts 64 letters besides."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size >= most:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names, dtype=object)


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most; a slice copies nothing."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
