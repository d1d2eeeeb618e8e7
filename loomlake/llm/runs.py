"""Sorted runs of a key over range partitions: a run of any length is cut into blocks that several tasks may hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in range partitions by ``order``, each sorted. Keys with many rows end up in several partitions."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def rows_of(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)))


def blocks(rows: Iterator[tuple], size: int, keys: int = 1) -> Iterator[tuple[tuple, list[tuple], bool, bool]]:
    """(key, rows, begins, ends) for runs of equal first ``keys`` columns, cut at ``size`` rows.

    ``begins`` and ``ends`` tell that surely no other block holds earlier or later rows of the key; at the edges of
    a partition that is not known, and both are false there.
    """
    key, held, begins = None, [], False
    for row in rows:
        if held and row[:keys] != key:
            yield key, held, begins, True
            held, begins = [], True
        elif len(held) == size:
            yield key, held, begins, False
            held, begins = [], False
        key = row[:keys]
        held.append(row)
    if held:
        yield key, held, begins, False


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


def map_stream(df: DataFrame, made: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, step: int = 1024) -> DataFrame:
    """``mapInArrow`` for a function of a partition's rows; ``step`` rows at a time are held as Python values."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)
            held.clear()
            return batch

        for row in made(rows_of(batches, step)):
            held.append(row)
            if len(held) == step:
                yield flush()
        if held:
            yield flush()

    return df.mapInArrow(run, schema)
