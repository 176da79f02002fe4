"""Packing by optimal length buckets.

The corpus's length histogram is one grouped count; dynamic programming over
it picks the bucket bounds that need the least padding. Inside a bucket, rows
are numbered and cut into batches that hold as many rows as the token budget
allows at the bucket's bound. Numbering is split: a bucket is dealt into
shards of about ``SHARD`` rows, rows are numbered inside their shard and
shifted by the shards before, so a bucket that holds most rows is many tasks.

The histogram that reaches the driver has one row for each distinct length,
unrounded, so the bounds are optimal at every length. As d distinct lengths
need at least d^2 / 2 tokens, a corpus of T tokens has at most sqrt(2 T) of
them: about six million for 100 TB of text. Solving that many is two to three
minutes of one core and some 500 MB of the driver (two arrays of longs, prefix
sums, two layers of costs and cuts), measured.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BUCKETS = 16
TOKENS = 65_536
SHARD = 20_000
CHUNK = 500_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space and one end mark."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _layer(best: np.ndarray, lengths: np.ndarray, rows: np.ndarray, held: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """One bucket more: for every j the least cost up to j and the cut before the last bucket (-1: none pays).

    Divide and conquer, breadth first: all middles of a level are solved side
    by side, each over the range of cuts that its neighbours leave, ``chunk``
    cuts at a time.
    """
    n = len(lengths)
    new, cut = best.copy(), np.full(n, -1, np.int32)
    low, high, left, right = (np.array([x], np.int32) for x in (0, n - 1, 0, n - 1))
    while len(low):
        j = (low + high) // 2
        size = np.maximum(np.minimum(right, j - 1) - left + 1, 0)
        first = np.r_[0, np.cumsum(size, dtype=np.int64)]
        least, at = np.full(len(j), np.inf), left.copy()
        for begin in range(0, int(first[-1]), chunk):
            end = min(begin + chunk, int(first[-1]))
            a, z = int(np.searchsorted(first, begin, side="right")) - 1, int(np.searchsorted(first, end))
            part = np.minimum(first[a + 1 : z + 1], end) - np.maximum(first[a:z], begin)
            own = np.repeat(np.arange(a, z, dtype=np.int32), part)
            i = (left[own] - first[own] + np.arange(begin, end)).astype(np.int32)
            up = j[own]
            cost = best[i] + lengths[up] * (rows[up + 1] - rows[i + 1]) - (held[up + 1] - held[i + 1])
            who = a + np.flatnonzero(part)
            start = np.r_[0, np.cumsum(part[who - a])[:-1]]
            lowest = np.minimum.reduceat(cost, start)
            hit = np.flatnonzero(cost == np.repeat(lowest, part[who - a]))
            hit = hit[np.r_[True, own[hit][1:] != own[hit][:-1]]]  # the first of equal costs
            better = lowest < least[who]
            least[who[better]], at[who[better]] = lowest[better], i[hit][better]
        pays = least < new[j]
        new[j[pays]], cut[j[pays]] = least[pays], at[pays]
        del first, least, size, pays
        below, above = low < j, j < high
        low, high = np.r_[low[below], j[above] + 1], np.r_[j[below] - 1, high[above]]
        left, right = np.r_[left[below], at[above]], np.r_[at[below], right[above]]
    return new, cut


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (members of the sorted ``lengths``) of at most ``buckets`` buckets with the least padding.

    The cost of a bucket from i to j, lengths[j] * rows - tokens, satisfies the
    quadrangle inequality, so the best cut moves one way with j. No layer's
    cuts are kept: the upper half of the layers carries along where the lower
    half ends, and both sides of that place are solved again by themselves, so
    memory is a few arrays whatever the number of buckets.
    """
    if not len(lengths):
        return []
    rows = np.r_[0.0, np.cumsum(counts, dtype=np.float64)]
    held = np.r_[0.0, np.cumsum(counts * lengths, dtype=np.float64)]

    def solved(low: int, high: int, k: int) -> list[int]:
        """The last members of at most k buckets over low..high."""
        k = min(k, high - low + 1)
        if k == 1:
            return [high]
        own, r, h = lengths[low : high + 1], rows[low : high + 2], held[low : high + 2]
        best, half = own * (r[1:] - r[0]) - (h[1:] - h[0]), k // 2
        for layer in range(2, k + 1):
            best, cut = _layer(best, own, r, h)
            if layer == half + 1:
                ends = np.where(cut >= 0, cut, np.arange(len(own), dtype=np.int32))
            elif layer > half + 1:
                ends = np.where(cut >= 0, ends[cut], ends)
        middle = low + int(ends[-1])
        del best, cut, ends
        return solved(low, middle, half) + (solved(middle + 1, high, k - half) if middle < high else [])

    return [int(lengths[j]) for j in solved(0, len(lengths) - 1, buckets)]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = BUCKETS, tokens: int = TOKENS, shard: int = SHARD) -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens``, ``bucket``, ``bucket_tokens``, ``batch_id``, ``slot``, ``batch_rows``.

    ``bucket_tokens`` is the length to which the bucket's rows are padded and
    ``batch_rows`` how many rows of it fit the token budget (one where a row
    alone exceeds it). Only a bucket's last batch may hold fewer. A null text
    is empty and has length 1; ties in length share a bucket; repeated rows
    get slots of their own; an empty table gives no row; other columns are
    ignored. Texts of any length are counted whole.
    """
    length = word_count(F.col(text_col)) if length is None else length
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.greatest(length, F.lit(1)).cast("long").alias("n_tokens"))
    rows = saved(rows, "pack-lengths")
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas().sort_values("n_tokens")
    lengths, counts = hist["n_tokens"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    del hist
    bounds = best_bounds(lengths, counts, buckets)
    if not bounds:
        return rows.select(F.col("id").alias(id_col), "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_tokens"), F.lit(0).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("batch_rows"))
    sizes = np.add.reduceat(counts, np.r_[0, np.searchsorted(lengths, bounds[:-1], side="right")])
    fit = [max(1, tokens // b) for b in bounds]
    first_batch = np.r_[0, np.cumsum([-(-int(n) // f) for n, f in zip(sizes, fit, strict=True)])][:-1]

    def pick(values) -> Column:
        last = F.lit(int(values[-1])).cast("long")
        return reduce(lambda rest, k: F.when(F.col("bucket") == k, F.lit(int(values[k])).cast("long")).otherwise(rest), reversed(range(len(values) - 1)), last)

    bucket = reduce(lambda rest, k: F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(rest), reversed(range(len(bounds) - 1)), F.lit(len(bounds) - 1))
    dealt = rows.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("row"), pick([-(-int(n) // shard) for n in sizes])))
    filled = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = filled.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "row")) - 1
    numbered = dealt.withColumn("number", number).join(before, ["bucket", "shard"]).withColumn("number", F.col("number") + F.col("before"))
    numbered = numbered.withColumn("batch_rows", pick(fit))
    return numbered.select(
        F.col("id").alias(id_col), "n_tokens", "bucket", pick(bounds).alias("bucket_tokens"),
        (pick(first_batch) + F.floor(F.col("number") / F.col("batch_rows"))).alias("batch_id"), (F.col("number") % F.col("batch_rows")).alias("slot"), "batch_rows",
    )
