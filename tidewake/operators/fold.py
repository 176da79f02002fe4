"""Ordered folds over groups: ``fold`` returns one value a group, ``scan`` rows for every row.

``fold`` sorts a group's rows as one array and folds it in the JVM. ``scan``
streams sorted rows through a state machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], initial: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> DataFrame:
    """One row per group: ``out`` = finish(fold of step over the rows in order, from ``initial``)."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[v for v in values if v not in order])))
    grouped = df.groupBy(*keys).agg(rows.alias("_rows"))
    return grouped.select(*keys, F.aggregate("_rows", initial, step, finish).alias("out"))


def scan(df: DataFrame, keys: list[str], order: list[str], values: list[str], machine: Callable[[], Callable[..., Iterable[tuple]]], out: str) -> DataFrame:
    """Rows from a state machine run over every group in order: ``keys`` and the columns ``out`` (a schema).

    ``machine()`` makes a fresh step for a group; ``step(*order, *values)``
    takes a row, with nulls as None, and returns any number of output rows.
    Groups are dealt by key and sorted; a task streams its rows through in
    Arrow batches and carries the state from one batch to the next, so time is
    linear and no group is held in memory.
    """
    columns = [*keys, *order, *[v for v in values if v not in order]]
    kinds = StructType([df.schema[k] for k in keys] + StructType.fromDDL(out).fields)
    arrow, held = to_arrow_schema(kinds), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for batch in batches:
            found = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = row[:held]
                if step is None or key != current:
                    current, step = key, machine()
                found += [key + item for item in step(*row[held:])]
            columns_out = zip(*found, strict=True) if found else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns_out, arrow, strict=True)], schema=arrow)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)
