"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ten words of all benchmark items; an item of fewer
words is one pattern. Patterns of one length are searched together:

* a **shift table** says for the hash of a block of two words how far the
  search may jump: blocks in no pattern jump over all but one word of a
  window, others to where the block may stand in one. Tables have a fixed
  size whatever the benchmark's (at most ``2^TABLE_BITS`` bytes), so they are
  what is sent to the tasks; a fuller table jumps less far and is as exact;
* a **bucket table** of the same kind keeps those positions with shift 0
  whose prefix and suffix blocks some pattern has: these are candidates;
* **direct comparison**: candidates meet the patterns of their bucket in a
  join on the bucket and the whole window.

The benchmark itself is never sent whole to a task, and frequent passages,
which are candidates in many documents, take their pattern's facts from a
broadcast of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, looked_up, payloads, saved, slices

WINDOW = 10
BLOCK = 2
TABLE_BITS = 24
#: Windows of so many items list these in their row; those of more are joined.
LISTED = 64
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD.encode())


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


# -- patterns and tables --------------------------------------------------


def patterns(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(``item``, ``window``): every window of every item once, words joined by a space; items without words have none."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window + 1, F.lit(1))
    each = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice("words", k, F.lit(window)), " "))).alias("window"))
    return each.distinct()


def _width(length: int, block: int) -> int:
    return min(block, length)


@dataclass
class Tables:
    """Shift and bucket tables of the patterns of one length; hashes are cut to ``mask``."""

    length: int
    block: int
    mask: int
    shift: bytes
    bucket: bytes


def tables(windows: DataFrame, block: int = BLOCK, most_bits: int = TABLE_BITS) -> list[Tables]:
    """Tables for the distinct ``window`` rows, one pair for each length in words that occurs.

    The least shift of every slot is a grouped minimum; at most one row a slot
    reaches the driver. The number of slots follows from the number of
    patterns, up to ``2^most_bits``, and changes only the cost.
    """
    split = windows.select(F.split("window", " ").alias("w")).withColumn("length", F.size("w"))
    out = []
    for length, n in sorted(tuple(r) for r in split.groupBy("length").count().collect()):  # at most as many rows as a window has words
        b = _width(length, block)
        bits = min(most_bits, max(12, (16 * n * (length - b + 1)).bit_length()))
        own, slots = split.where(F.col("length") == length), 1 << bits
        at = lambda x: F.crc32(F.array_join(x, " ").cast("binary")) % slots  # noqa: B023, E731
        places = F.transform(F.sequence(F.lit(0), F.lit(length - b)), lambda p: F.struct(at(F.slice("w", p + 1, F.lit(b))).alias("slot"), (length - b - p).alias("shift")))  # noqa: B023
        jumps = own.select(F.explode(places).alias("p")).groupBy("p.slot").agg(F.min("p.shift").alias("shift")).toPandas()
        ends = own.select(at(F.concat(F.slice("w", F.lit(1), F.lit(b)), F.slice("w", F.lit(length - b + 1), F.lit(b)))).alias("slot")).distinct().toPandas()
        shift, bucket = np.full(slots, min(length - b + 1, 255), np.uint8), np.zeros(slots, np.uint8)
        shift[jumps["slot"].to_numpy(np.int64)] = np.minimum(jumps["shift"].to_numpy(np.int64), 255)
        bucket[ends["slot"].to_numpy(np.int64)] = 1
        out.append(Tables(length, b, slots - 1, shift.tobytes(), bucket.tobytes()))
    return out


# -- search ---------------------------------------------------------------


def search(found: list[bytes], t: Tables) -> Iterator[tuple[int, bytes]]:
    """Candidates (first word's place, window) in the words of a text: every pattern of ``t`` that stands there, and perhaps others."""
    length, b, mask, shift, bucket = t.length, t.block, t.mask, t.shift, t.bucket
    join, n, at = b" ".join, len(found), length
    while at <= n:  # the window ends before word ``at``
        jump = shift[crc32(join(found[at - b : at])) & mask]
        if jump:
            at += jump
            continue
        first = at - length
        if bucket[crc32(join(found[first : first + b] + found[at - b : at])) & mask]:
            yield first, join(found[first:at])
        at += 1


def candidates(docs: DataFrame, sent: list[Tables]) -> DataFrame:
    """``docs`` (id, row, text) searched: (``id``, ``row``, ``n_words``, ``found``: array of (start, window))."""
    kind = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(sent)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("window", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, found = [], []
            for text in payloads(batch.column(2)):
                own = _WORD.findall(text.lower())
                counts.append(len(own))
                found.append([{"start": k, "window": w.decode()} for t in shared.value for k, w in search(own, t)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(found, spans)], ["id", "row", "n_words", "found"])

    return docs.mapInArrow(run, f"id {kind}, row long, n_words long, found array<struct<start:int,window:string>>")


def covered(spans: Column) -> Column:
    """How many words the sorted ``spans`` (start, end exclusive) cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"].cast("long"), s["reach"]), F.lit(0))).alias("n"), F.greatest(s["reach"], x["end"].cast("long")).alias("reach"))
    return F.aggregate(spans, zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK, listed: int = LISTED, most_bits: int = TABLE_BITS) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``hits`` (array of (start, end), sorted, in words), ``n_hit``, ``items`` (sorted).

    ``hits`` are all occurrences of benchmark windows, ``n_hit`` the words
    inside any of them, ``items`` the ids (as strings) of the items whose
    windows occur. Null texts and items have no words; a null item id is the
    empty string; items of one id count once; repeated rows are each searched;
    an empty table gives no row, an empty benchmark no hit; other columns are
    ignored. Texts of any length are searched whole.
    """
    pairs = saved(patterns(benchmark, item_col, item_text_col, window), "leak-patterns")
    widths = pairs.groupBy("window").agg(F.count("*").alias("width"))
    few = pairs.join(widths.where(F.col("width") <= listed), "window").groupBy("window").agg(F.collect_list("item").alias("items"), F.count("*").alias("width"))
    many = widths.where(F.col("width") > listed).select("window", F.array().cast("array<string>").alias("items"), "width")
    b = F.least(F.lit(block), F.size("w"))
    bucket = F.crc32(F.array_join(F.concat(F.slice("w", F.lit(1), b), F.slice("w", F.size("w") - b + 1, b)), " ").cast("binary"))
    known = few.unionByName(many).withColumn("w", F.split("window", " ")).select("window", F.size("w").alias("length"), bucket.alias("bucket"), "items", "width")
    known = saved(known, "leak-windows")
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    found = saved(candidates(rows, tables(known, block, most_bits)), "leak-candidates")
    some = found.where(F.size("found") > 0)
    seen = some.select("row", F.explode("found").alias("c")).select("row", "c.start", "c.window")
    facts = seen.groupBy("window").agg(F.count("*").alias("n")).join(known, "window")  # the direct comparison
    hits = looked_up(seen, saved(facts, "leak-facts"), ["window"], "n")
    hits = saved(hits.select("row", "start", (F.col("start") + F.col("length")).alias("end"), "items", F.when(F.col("width") > listed, F.col("window")).alias("wide")), "leak-hits")
    own = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"))
    listed_items = hits.select("row", F.explode("items").alias("item"))
    joined_items = hits.where(F.col("wide").isNotNull()).select("row", F.col("wide").alias("window")).distinct().join(pairs, "window").select("row", "item")
    items = listed_items.unionByName(joined_items).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    met = some.select("id", "row", "n_words").join(own.join(items, "row"), "row", "left").select("id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    clean = found.where(F.size("found") == 0).select("id", "n_words", none.alias("hits"), F.array().cast("array<string>").alias("items"))
    return clean.unionByName(met).select(F.col("id").alias(id_col), "n_words", "hits", covered(F.col("hits")).alias("n_hit"), "items")
