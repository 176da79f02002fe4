"""SimHash near-duplicates by a Gray-order hierarchical index.

A document's fingerprint has a bit set where more than half of its 4-word
shingles' XXH64 hashes (seed 42) have it. Two fingerprints link at four or
fewer differing bits; a component is everything reachable over links.

The index has three kinds of nodes. The upper ones are masked bit patterns:
the 64 bits are cut into ``m`` blocks, and every choice of ``m - 4`` blocks is
one mask; two fingerprints within four bits agree on at least one of them, so
a shuffle by (mask, masked pattern) brings every linked pair together at least
once. ``m`` follows from the number of distinct fingerprints and changes only
the cost. Below an upper node the members are sorted by Gray rank; runs of
eight neighbours are factored into a node that keeps the bits they share, runs
of eight nodes into the next level. Pairs of nodes descend together and are
dropped as soon as their shared bits differ in more than four places, or as
soon as both lie in one known component.

A masked pattern with more than ``BLOCK`` members is dealt into blocks, and
every pair of blocks is a task of its own, so that no task holds more than two
blocks however many members a pattern has. A pattern of n members is copied
n / ``BLOCK`` times for that: comparing a crowd with itself stays quadratic at
the extreme, the price of exact links. Tasks return spanning links, never all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAD, drop_saved, looked_up, payloads, saved, slices
from .components import components

WORDS = 4
SEED = 42
DISTANCE = 4
BLOCK = 16_384
FAN = 8


# -- fingerprints ---------------------------------------------------------


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the unsigned 64-bit hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(n, 64)
    lanes = bits.view(np.uint64)  # eight counters of eight bits each
    for at in range(0, n, 255):
        counts += lanes[at : at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text; a text of fewer words is one shingle, one without words is 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = [0, *ends[: len(tokens) - words].tolist()]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the fingerprint as a signed long ``fp``, one row per input row.

    Null, empty and blank texts have fingerprint 0; a text of up to four words
    is one shingle; repeated rows are each printed; an empty table gives no
    row; other columns are ignored. A text is hashed whole, with memory in
    proportion to it.
    """
    words = WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(x, words) for x in payloads(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")
    return out.withColumnRenamed("id", id_col)


# -- the index ------------------------------------------------------------


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Where a code stands in Gray order."""
    out = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Union:
    """Array union-find; vectorised linking, labels are the smallest position."""

    def __init__(self, n: int):
        self.to = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            keep = a != b
            a, b = a[keep], b[keep]
            np.minimum.at(self.to, np.maximum(a, b), np.minimum(a, b))

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.to[x]
            if (up == x).all():
                return x
            self.to[x] = self.to[up]
            x = up

    def labels(self) -> np.ndarray:
        return self.find(np.arange(len(self.to)))


def _levels(fps: np.ndarray, group: np.ndarray) -> list[dict]:
    """Bottom-up: each level's first child, child count, mask and pattern of shared bits, and group."""
    every = np.full(len(fps), ~np.uint64(0))
    out = [{"first": np.arange(len(fps)), "n": np.ones(len(fps), np.int64), "mask": every, "bits": fps, "group": group}]
    while True:
        low = out[-1]
        new = np.r_[True, low["group"][1:] != low["group"][:-1]]
        if new.all():
            return out
        start = np.flatnonzero(new)
        rank = np.arange(len(new)) - np.repeat(start, np.diff(np.r_[start, len(new)]))
        first = np.flatnonzero(rank % FAN == 0)
        ones, zeros = np.bitwise_and.reduceat(low["mask"] & low["bits"], first), np.bitwise_and.reduceat(low["mask"] & ~low["bits"], first)
        out.append({"first": first, "n": np.diff(np.r_[first, len(new)]), "mask": ones | zeros, "bits": ones, "group": low["group"][first]})


def spanning_links(fps: np.ndarray, group: np.ndarray, most: int = DISTANCE, chunk: int = 200_000) -> np.ndarray:
    """For each position the smallest position it is joined with, inside its group.

    ``fps`` is sorted by group and, inside a group, by Gray rank.
    """
    union = Union(len(fps))
    if len(fps) < 2:
        return union.labels()
    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= most))
    union.link(near, near + 1)  # neighbours in Gray order
    levels = _levels(fps, group)
    top = np.arange(len(levels[-1]["first"]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > chunk:
            stack.append((level, a[chunk:], b[chunk:]))
            a, b = a[:chunk], b[:chunk]
        at = levels[level]
        differ = np.bitwise_count((at["bits"][a] ^ at["bits"][b]) & at["mask"][a] & at["mask"][b])
        keep = differ <= most
        a, b = a[keep], b[keep]
        if level == 0:
            keep = a != b
            union.link(a[keep], b[keep])
            continue
        if level <= 2:  # both nodes whole in one component: nothing to learn
            low, high = _ends(levels, level, a, b)
            one = union.find(low[0])
            same = (one == union.find(low[1])) & (one == union.find(high[0])) & (one == union.find(high[1]))
            if same.any():
                labels = union.labels()
                same[same] = [len(np.unique(labels[i:j])) == 1 and len(np.unique(labels[k:m])) == 1 for i, j, k, m in zip(low[0][same], high[0][same] + 1, low[1][same], high[1][same] + 1, strict=True)]
                a, b = a[~same], b[~same]
        for at_once in range(0, len(a), chunk // (FAN * FAN)):
            x, y = a[at_once : at_once + chunk // (FAN * FAN)], b[at_once : at_once + chunk // (FAN * FAN)]
            stack.append((level - 1, *_children(at, x, y)))
    return union.labels()


def _ends(levels: list[dict], level: int, a: np.ndarray, b: np.ndarray) -> tuple:
    low, high = [a, b], [a, b]
    for k in range(level, 0, -1):
        at = levels[k]
        low, high = [at["first"][x] for x in low], [at["first"][x] + at["n"][x] - 1 for x in high]
    return low, high


def _children(at: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a and a child of b; each unordered pair once where a is b."""
    step = np.arange(FAN)
    i, j = np.broadcast_arrays(step[:, None], step[None, :])
    ok = (i[None] < at["n"][a][:, None, None]) & (j[None] < at["n"][b][:, None, None]) & ((a != b)[:, None, None] | (i <= j)[None])
    x, y = at["first"][a][:, None, None] + i[None], at["first"][b][:, None, None] + j[None]
    return x[ok], y[ok]


# -- distributed search ---------------------------------------------------


def masks(count: int, bits: int = 64, most: int = DISTANCE, members: int = 4) -> list[list[tuple[int, int]]]:
    """The block choices that route ``count`` fingerprints: about ``members`` by chance under a pattern."""
    for m in range(most + 1, most + 4):
        edges = [round(k * bits / m) for k in range(m + 1)]
        blocks = list(zip(edges[:-1], edges[1:], strict=True))
        if count <= members << min(sum(sorted(b - a for a, b in blocks)[: m - most]), 62):
            break
    return [list(x) for x in combinations(blocks, m - most)]


def _pattern(fp: Column, number: int, choice: list[tuple[int, int]]) -> Column:
    key = F.lit(number)
    for a, b in choice:
        key = F.shiftleft(key.cast("long"), b - a).bitwiseOR(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
    return key


def links(nodes: DataFrame, count: int, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """Spanning links (``src``, ``dst``) between the distinct fingerprints of column ``fp``.

    The crowded patterns may be many: the ``head`` largest meet their rows in a
    broadcast of that many rows, the others in a join in which none of them has
    more than one in ``head`` of the rows.
    """
    choices = masks(count)
    routed = nodes.select(F.explode(F.array(*[_pattern(F.col("fp"), k, c) for k, c in enumerate(choices)])).alias("key"), "fp")
    hot = routed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("blocks"))
    hot = saved(hot, "simhash-hot")
    top = hot.orderBy(F.desc("blocks"), "key").limit(head)  # the heaviest patterns' rows pass without a shuffle, no other is hot
    marked = routed.join(F.broadcast(top), "key", "left")
    rest = hot.join(F.broadcast(top.select("key")), "key", "left_anti")
    far = marked.where(F.col("blocks").isNull()).drop("blocks").join(rest, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    routed = marked.where(F.col("blocks").isNotNull()).unionByName(far)
    own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("blocks"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.least(k, own) * F.col("blocks") + F.greatest(k, own)))
    dealt = routed.select("key", F.explode(pairs).alias("pair"), "fp").select(F.xxhash64("key", "pair").alias("cell"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((gray_rank(fp), cell))
            cell, fp = cell[order], fp[order]
            root = spanning_links(fp, cell)
            own = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[root[own]].view(np.int64))], ["src", "dst"])

        for batch in batches:
            cell, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            held.append((cell, fp.view(np.uint64)))
            if cell[0] == cell[-1] == held[0][0][-1]:
                continue
            cell, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            held = [(cell[cut:], fp[cut:])]
            if cut:
                yield flush(cell[:cut], fp[:cut])
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    found = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "src long, dst long")
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``fp`` (signed long), ``component_id``.

    ``component_id`` is the smallest id reachable over links. Null and empty
    texts have fingerprint 0 and link like any other; repeated rows and equal
    texts share a fingerprint and so a component; a null id never becomes a
    component's id unless there is no other; an empty table gives no row; other
    columns are ignored. Texts of any length are read whole, one at a time.
    """
    prints = saved(fingerprints(docs, id_col, text_col), "simhash-prints")
    prints = prints.select(F.col(id_col).alias("id"), "fp")
    nodes = saved(prints.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "simhash-nodes")
    found = saved(links(nodes.select("fp"), nodes.count()), "simhash-links")
    roots = components(found)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = saved(named, "simhash-roots")
    firsts = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    own = saved(looked_up(named, firsts, ["root"], "members").select("fp", "component_id", "n"), "simhash-classes")
    for table in (found, roots, nodes, named):
        drop_saved(table)
    return looked_up(prints, own, ["fp"], "n").select(F.col("id").alias(id_col), "fp", "component_id")
