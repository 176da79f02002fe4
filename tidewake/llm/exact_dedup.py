"""Exact deduplication over a cuckoo-filter index.

A text's content key is the SHA-256 and byte length of its UTF-8 form with A-Z
lower-cased. Every task streams its rows through a :class:`CuckooIndex`: a
lookup that misses both buckets proves a key new; one that hits is verified
against the content record stored in the bucket, so a filter's false positive
never joins two groups. First each input task folds its own copies together,
then the folded rows are dealt by digest and folded again; a text copied into
a third of all rows reaches the second pass as one row per input task. The rows
of the largest groups learn their group from a broadcast of bounded size, the
others from a join.

Tasks keep at most ``LIVE`` keys. A full index emits its live digests and
deletes them one by one; in the first pass the second one joins the parts, and
the second reads its rows in digest order, so the digests deleted there are
complete. A live digest that moves to a later row is deleted and put anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, payloads, saved

LIVE = 200_000
SLOTS = 4
KICKS = 200


class CuckooIndex:
    """Cuckoo filter (16-bit tags, four slots a bucket) whose slots also hold the keys' records.

    ``put``, ``get`` and ``delete`` take the key's digest (bytes) and length. A
    key may be stored once. When an insertion finds no place after ``KICKS``
    moves, the table doubles and is filled again from the stored keys.
    """

    def __init__(self, buckets: int = 64):
        self.size = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = [0] * (buckets * SLOTS)
        self.records: list = [None] * (buckets * SLOTS)
        self.turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995 >> 3) & self.mask)

    def _find(self, digest: bytes, length: int) -> int:
        tag, first, second = self._places(digest)
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[at] == tag:  # the filter says perhaps: verify the content record
                    record = self.records[at]
                    if record[0] == digest and record[1] == length:
                        return at
        return -1

    def get(self, digest: bytes, length: int) -> list | None:
        at = self._find(digest, length)
        return None if at < 0 else self.records[at]

    def put(self, record: list) -> None:
        """Store a record that begins with digest and length; its key must not be stored yet."""
        self.size += 1
        while not self._place(record):
            pass

    def _place(self, record: list) -> bool:
        tag, first, second = self._places(record[0])
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[at]:
                    self.tags[at], self.records[at] = tag, record
                    return True
        bucket = second
        for _ in range(KICKS):
            self.turn = (self.turn + 1) % SLOTS
            at = bucket * SLOTS + self.turn
            self.tags[at], tag = tag, self.tags[at]
            self.records[at], record = record, self.records[at]
            bucket = self._other(bucket, tag)
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[at]:
                    self.tags[at], self.records[at] = tag, record
                    return True
        self._resize(record)
        return True

    def _resize(self, homeless: list) -> None:
        stored = [x for x in self.records if x is not None] + [homeless]
        self._empty((self.mask + 1) * 2)
        for record in stored:
            self._place(record)

    def delete(self, digest: bytes, length: int) -> list | None:
        at = self._find(digest, length)
        if at < 0:
            return None
        record, self.tags[at], self.records[at] = self.records[at], 0, None
        self.size -= 1
        return record

    def __iter__(self) -> Iterator[list]:
        return (x for x in self.records if x is not None)

    def __len__(self) -> int:
        return self.size


def content_key(text: bytes) -> tuple[bytes, int]:
    return hashlib.sha256(text.lower()).digest(), len(text)


def _later(a: tuple, b: tuple) -> bool:
    """Whether (id, row) a comes after b; a null id comes before all others."""
    return (a[0] is not None, a[0] if a[0] is not None else 0, a[1]) > (b[0] is not None, b[0] if b[0] is not None else 0, b[1])


def _batch(records: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*records, strict=True) if records else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _folded(batches: Iterator[pa.RecordBatch], ordered: bool, live: int) -> Iterator[pa.RecordBatch]:
    """Records (digest, length, id, row, n) with one record a key; of several the latest (id, row) stays."""
    index, schema = CuckooIndex(), None
    for batch in batches:
        schema = batch.schema
        for digest, length, key, row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(index) >= live and (not ordered or index.get(digest, length) is None):
                yield _batch([index.delete(*x[:2]) for x in list(index)], schema)
            record = index.get(digest, length)
            if record is None:
                index.put([digest, length, key, row, n])
            elif _later((key, row), (record[2], record[3])):  # the live digest moves to another row
                n += index.delete(digest, length)[4]
                index.put([digest, length, key, row, n])
            else:
                record[4] += n
    if len(index):
        yield _batch(list(index), schema)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", live: int = LIVE, row_col: str | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``row``, ``digest``, ``keep_id``, ``keep_row``, ``group_size``, ``kept``.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts the row with the largest id stays, and of repeated
    rows with that id one; a null id is the smallest. ``row`` numbers the input
    rows (no order is promised) or is ``row_col``, a long that each row has of its own. An empty table gives no row; other columns are
    ignored. Texts of any length are hashed whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, lengths = zip(*map(content_key, payloads(batch.column(2))), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(lengths, pa.int64()), batch.column(0), batch.column(1)], ["digest", "length", "id", "row"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _folded(batches, False, live)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _folded(batches, True, live)

    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(F.col(id_col).alias("id"), number.alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = saved(rows.mapInArrow(keys, f"digest binary, length long, id {kind}, row long"), "dedup-keys")
    schema = f"digest binary, length long, id {kind}, row long, n long"
    parts = rows.withColumn("n", F.lit(1).cast("long")).mapInArrow(fold, schema)
    groups = parts.repartition("digest").sortWithinPartitions("digest", "length").mapInArrow(join, schema)
    groups = groups.select("digest", "length", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"), F.col("n").alias("weight"))
    out = looked_up(rows, saved(groups, "dedup-groups"), ["digest", "length"], "weight").withColumn("kept", F.col("row") == F.col("keep_row"))
    return out.select(F.col("id").alias(id_col), "row", "digest", "keep_id", "keep_row", "group_size", "kept")
