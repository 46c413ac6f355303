"""Whole groups of rows in Arrow tables, many small groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that are handed on together; a larger group comes alone.
ROWS_AT_ONCE = 1 << 16


def _changes(column: pa.Array) -> np.ndarray:
    """For every value but the first, whether it differs from the one before; nulls are equal."""
    if pa.types.is_struct(column.type):
        out = np.zeros(max(0, len(column) - 1), dtype=bool)
        for field in column.flatten():
            out |= _changes(field)
        return out
    left, right = column[:-1], column[1:]
    differ = pc.fill_null(pc.not_equal(left, right), False).to_numpy(zero_copy_only=False)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return differ | (missing[1:] != missing[:-1])


def group_starts(rows: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places at which a group starts, in rows sorted by group."""
    changed = np.zeros(max(0, rows.num_rows - 1), dtype=bool)
    for key in keys:
        column = rows.column(key)
        changed |= _changes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return np.concatenate([np.zeros(min(1, rows.num_rows), dtype=np.int64), np.flatnonzero(changed) + 1])


def per_group(
    df: DataFrame, keys: list[str], result: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]], schema: str
) -> DataFrame:
    """``keys`` and what ``result`` finds for each group; one shuffle by the keys.

    ``result`` gets the rows of many groups, sorted by group, with the number of each row's group from 0. It
    returns one value per group and column. A group must fit a task; the groups of a call hold
    ``ROWS_AT_ONCE`` rows, or one group more. ``schema`` names the result columns.
    """
    rows_at_once = ROWS_AT_ONCE
    names = [part.split()[0] for part in schema.split(", ")]

    def found(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(starts, append=rows.num_rows)
        columns = result(rows, np.repeat(np.arange(len(starts)), sizes))
        first = rows.select(keys).take(pa.array(starts)).combine_chunks()
        arrays = [first.column(k).combine_chunks() for k in keys] + [pa.array(columns[n]) for n in names]
        return pa.RecordBatch.from_arrays(arrays, [*keys, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < rows_at_once:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            starts = group_starts(rows, keys)
            if len(starts) > 1:  # the last group may go on
                yield found(rows.slice(0, starts[-1]), starts[:-1])
                rows = rows.slice(starts[-1])
            held = rows.to_batches()
            size = 0 if len(starts) > 1 else size - rows_at_once
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows:
                yield found(rows, group_starts(rows, keys))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{types}, {schema}")
