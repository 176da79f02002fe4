"""What the operators share: tables, the shared folder, Arrow access to texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import clean_up, drop_saved, saved, shared_dir  # noqa: F401

#: So many of the most frequent keys are joined by a broadcast in :func:`looked_up`.
HEAD = 4_096

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, head: int = HEAD) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row for each value of ``keys``; fixed-size columns), inner.

    ``weight`` says how many rows a key has. The ``head`` heaviest keys meet
    their facts in a broadcast of at most ``head`` rows and are not shuffled;
    of the others none has more than one in ``head`` of the rows, so no task
    of the shuffled join is hot. The result is the whole inner join.
    """
    top = facts.orderBy(F.desc(weight), *keys).limit(head)
    hot = rows.join(F.broadcast(top.drop(weight)), keys)
    cold = rows.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(facts.drop(weight), keys)
    return hot.unionByName(cold)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, in the JVM."""
    return F.translate(text, UPPER, LOWER)


def fold(part: int, of: int, key: Column) -> Column:
    """Whether crc32 of the key's decimal text leaves ``part`` modulo ``of``; null keys count as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of == part


def payloads(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``name``, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        if batch.num_rows < 2 or column.nbytes <= most:
            yield batch
            continue
        at, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
            if held and held + (n or 0) > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n or 0
        yield batch.slice(at)
