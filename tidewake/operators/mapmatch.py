"""Road matching: nearest segments, candidates, Viterbi.

Points meet edges through a grid: an edge is listed in every cell its box
touches, grown by the search radius, so a point looks only into its own cell.
The join is an equi-join on the cell; its work follows the edges near a point,
not their number. Long edges are split so that none lies in unboundedly many
cells.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import along
from ..shared import dealt, saved
from .numbering import numbered


def grids(centres: DataFrame, extent: int, step: float, key: str = "drive_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and two-way edges of a square grid of streets around every centre (key, x, y)."""
    line = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(extent - 1).cast("long")))
    nodes = centres.select(key, F.col("x").alias("cx"), F.col("y").alias("cy"), line().alias("i")).select("*", line().alias("j"))
    at = lambda c, middle: F.col(middle) + (F.col(c) - (extent - 1) / 2) * step
    nodes = nodes.select(key, (F.col("i") * extent + F.col("j")).alias("node"), "i", "j", at("i", "cx").alias("x"), at("j", "cy").alias("y"))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1))]))
    steps = nodes.select(key, "node", "i", "j", "x", "y", moves.alias("m"))
    i, j = F.col("i") + F.col("m.di"), F.col("j") + F.col("m.dj")
    inside = i.between(0, extent - 1) & j.between(0, extent - 1)
    edges = steps.where(inside).select(key, F.col("node").alias("u"), (i * extent + j).alias("v"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("m.di") * step).alias("x2"), (F.col("y") + F.col("m.dj") * step).alias("y2"))
    return nodes.select(key, "node", "x", "y"), edges.withColumn("edge", F.col("u") * extent * extent + F.col("v"))


def grid_graph(spark, extent: int, step: float) -> tuple[DataFrame, DataFrame]:
    """The grid around the origin."""
    nodes, edges = grids(spark.range(1).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), extent, step, "id")
    return nodes.drop("id"), edges.drop("id")


def road_graph(stored: DataFrame, points: DataFrame, key: str = "drive_id") -> DataFrame:
    """Edges (key, x1, y1, x2, y2, origin) for every key of ``points`` (key, x, y): the stored ones, and where there are
    none the diagonal of the points' bounding box, both ways."""
    ends = ("x1", "y1", "x2", "y2")
    low, high = [F.min("x").alias("x1"), F.min("y").alias("y1")], [F.max("x").alias("x2"), F.max("y").alias("y2")]
    boxes = points.groupBy(key).agg(*low, *high)
    bare = boxes.join(stored.select(key).distinct(), key, "left_anti")
    ways = F.explode(F.array(F.struct(*ends), F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))))
    diagonals = bare.select(key, ways.alias("w")).select(key, "w.*", F.lit("diagonal").alias("origin"))
    kept = stored.join(boxes.select(key), key, "left_semi").select(key, *ends, F.lit("stored").alias("origin"))
    return kept.unionByName(diagonals)


def waypoint_graph(points: DataFrame, allow_truth: bool = False, key: str = "drive_id", order: str = "idx") -> DataFrame:
    """Edges between consecutive points. A graph made of the truth leaks it: refused unless allowed."""
    if not allow_truth:
        raise ValueError("a graph of ground-truth points would leak the answer; pass allow_truth=True for diagnostics")
    o = Window.partitionBy(key).orderBy(order)
    edges = points.select(key, order, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(o).alias("x2"), F.lead("y").over(o).alias("y2"))
    return edges.where(F.col("x2").isNotNull())


def _cells(low, high, size: float):
    return F.sequence(F.floor(low / size), F.floor(high / size))


def near_edges(points: DataFrame, edges: DataFrame, radius: float, point: str = "event_id") -> DataFrame:
    """(point columns, edge, distance, px, py, along) for all edges within ``radius``. Points have x and y."""
    size = max(radius * 2, 1e-9)
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    parts = F.greatest(F.lit(1), F.ceil(length / (8 * size)))
    pieces = edges.withColumn("_parts", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    cut = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * (F.col("_k") + k) / F.col("_parts")
    xs, ys = (cut("x1", "x2", 0), cut("x1", "x2", 1)), (cut("y1", "y2", 0), cut("y1", "y2", 1))
    boxed = pieces.withColumn("_cx", F.explode(_cells(F.least(*xs) - radius, F.greatest(*xs) + radius, size))).withColumn("_cy", F.explode(_cells(F.least(*ys) - radius, F.greatest(*ys) + radius, size)))
    listed = boxed.select("edge", "x1", "y1", "x2", "y2", "_cx", "_cy").distinct()
    placed = points.withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))
    both = placed.join(listed, ["_cx", "_cy"]).withColumn("_at", along(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]))
    both = both.withColumn("px", F.col("x1") + F.col("_at") * (F.col("x2") - F.col("x1"))).withColumn("py", F.col("y1") + F.col("_at") * (F.col("y2") - F.col("y1")))
    both = both.withColumn("distance", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).withColumn("along", F.col("_at") * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return both.where(F.col("distance") <= radius).select(*points.columns, "edge", "distance", "px", "py", "along")


def nearest(points: DataFrame, edges: DataFrame, radius: float, point: str = "event_id") -> DataFrame:
    """``points`` with the nearest edge closer than ``radius`` (the lowest edge on ties), or nulls."""
    best = near_edges(points.select(point, "x", "y"), edges, radius, point).where(F.col("distance") < radius)
    best = best.groupBy(point).agg(F.min(F.struct("distance", "edge", "px", "py")).alias("b")).select(point, "b.edge", "b.distance", "b.px", "b.py")
    return points.join(best, point, "left")


def candidates(points: DataFrame, edges: DataFrame, sigma: float, most: int = 5, point: str = "event_id") -> DataFrame:
    """The ``most`` nearest edges within 3.5 sigma of each point, ranked; a point without any stands for itself (edge -1)."""
    found = near_edges(points, edges, 3.5 * sigma, point)
    rank = F.row_number().over(Window.partitionBy(point).orderBy("distance", "edge"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= most)
    alone = points.join(found.select(point).distinct(), point, "left_anti")
    zero = F.lit(0.0)
    return found.unionByName(alone.select("*", F.lit(-1).cast("long").alias("edge"), zero.alias("distance"), F.col("x").alias("px"), F.col("y").alias("py"), zero.alias("along"), F.lit(1).alias("rank")))


#: Log-probabilities are added as whole multiples of this, so that sums are exact in any grouping.
UNIT = 2.0**-20
_NEVER = -(1 << 58)
_COLUMNS = ("x", "y", "edge", "px", "py", "distance", "along")


def emission(distance: np.ndarray, sigma: float) -> np.ndarray:
    return np.rint((-0.5 * (distance / sigma) ** 2 - math.log(math.sqrt(2 * math.pi) * sigma)) / UNIT).astype(np.int64)


def transition(a: dict, b: dict, beta: float) -> np.ndarray:
    """(runs, from, to): what a move between two steps' candidates costs, from the straight and the routed distance."""
    moved = np.hypot(b["x"][:, 0] - a["x"][:, 0], b["y"][:, 0] - a["y"][:, 0])[:, None, None]
    pair = lambda c: (a[c][:, :, None], b[c][:, None, :])
    (ea, eb), (xa, xb), (ya, yb), (la, lb) = (pair(c) for c in ("edge", "px", "py", "along"))
    same = ea == eb
    routed = np.where(same & (eb != -1), np.abs(la - lb), np.hypot(xa - xb, ya - yb))
    return np.rint((-(np.abs(moved - routed) + np.where(same, 0.0, 2 * beta)) / beta - math.log(beta)) / UNIT).astype(np.int64)


def forward(c: dict, steps: np.ndarray, ok: np.ndarray, start: np.ndarray, sigma: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Max-plus products along many runs side by side.

    ``c`` has arrays (runs, length, candidates), ``steps`` the runs' lengths,
    ``ok`` which candidates exist and ``start`` (runs, entries, candidates) the
    scores at the first step. Returns the scores at each run's last step and
    the back-pointers (length, runs, entries, candidates); the first of equal
    predecessors is taken.
    """
    score, back = start, np.zeros((c["x"].shape[1], *start.shape), np.int8)
    stay = np.broadcast_to(np.arange(start.shape[2], dtype=np.int8), start.shape)
    for t in range(1, c["x"].shape[1]):
        a, b = ({k: v[:, t - d] for k, v in c.items()} for d in (1, 0))
        total = score[:, :, :, None] + transition(a, b, beta)[:, None]
        new = np.where(ok[:, t], emission(b["distance"], sigma), _NEVER)[:, None] + total.max(2)
        on = (t < steps)[:, None, None]
        back[t] = np.where(on, total.argmax(2), stay)
        score = np.where(on, np.maximum(new, _NEVER), score)
    return score, back


def traced(back: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The candidates along the paths that end in ``last`` (runs, entries, ends), as (length, runs, entries, ends)."""
    path = np.empty((len(back), *last.shape), np.int8)
    path[-1] = last
    for t in range(len(back) - 1, 0, -1):
        path[t - 1] = np.take_along_axis(back[t], path[t].astype(np.int64), 2)
    return path


def _packed(pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict, np.ndarray, np.ndarray, tuple]:
    """A bucket's blocks as padded arrays: the blocks, candidates, lengths, which exist, and each row's place."""
    run, t, k = pdf["_run"].to_numpy(), pdf["_at"].to_numpy(), pdf["rank"].to_numpy() - 1
    shape = (run.max() + 1, t.max() + 1, k.max() + 1)
    c = {name: np.zeros(shape) for name in _COLUMNS}
    ok = np.zeros(shape, bool)
    ok[run, t, k] = True
    for name in _COLUMNS:
        c[name][run, t, k] = pdf[name]
    steps = np.zeros(shape[0], np.int64)
    np.maximum.at(steps, run, t + 1)
    return pdf.drop_duplicates("_run").sort_values("_run"), c, steps, ok, (run, t, k)


def products(c: dict, steps: np.ndarray, ok: np.ndarray, first: np.ndarray, sigma: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Each block's matrix (entries, ends) of best scores, and for each end the order in which equal entries are taken.

    A block's last step is the next one's first, whose emission only the block
    before counts; ``first`` marks blocks that begin a track. Of equal paths
    the one counts that a walk back over the whole track would take: it has the
    smallest candidates from its end on.
    """
    n = ok.shape[2]
    own = np.where(first[:, None], np.where(ok[:, 0], emission(c["distance"][:, 0], sigma), 0), 0)
    start = np.where(np.eye(n, dtype=bool)[None] & ok[:, 0, :, None], own[:, :, None], _NEVER)
    score, back = forward(c, steps, ok, start, sigma, beta)
    path = traced(back, np.broadcast_to(np.arange(n, dtype=np.int8), score.shape))
    order = np.zeros(score.shape, np.int64)
    for t in range(len(path)):
        value = path[t].astype(np.int64) * n + order
        order = (value[:, :, None, :] > value[:, None, :, :]).sum(2)
    return score, order


def chained(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(entry, end) of every block of a track, from the blocks' matrices and orders."""
    n, back = len(blocks[0][0]), []
    score = np.zeros(n, np.int64)
    for k, (matrix, order) in enumerate(blocks):
        total = np.maximum((score[:, None] if k else 0) + matrix, _NEVER)
        best = total.max(0)
        back.append(np.where(total == best, order, n * n).argmin(0))
        score = best
    end = int(score.argmax())
    out = []
    for pointers in reversed(back):
        out.append((int(pointers[end]), end))
        end = out[-1][0]
    return out[::-1]


def walked(matrix: np.ndarray, order: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`chained` of many tracks side by side: (blocks, n, n) of track after track with ``lengths`` blocks each."""
    first, n = np.r_[0, np.cumsum(lengths)[:-1]], matrix.shape[1]
    score, back = np.zeros((len(lengths), n), np.int64), np.empty(matrix.shape[:2], np.int64)
    for k in range(int(lengths.max())):
        on = np.flatnonzero(lengths > k)
        at = first[on] + k
        total = np.maximum(score[on][:, :, None] + matrix[at], _NEVER)
        score[on] = total.max(1)
        back[at] = np.where(total == score[on][:, None], order[at], n * n).argmin(1)
    end, entries, ends = score.argmax(1), np.empty(len(matrix), int), np.empty(len(matrix), int)
    for k in reversed(range(int(lengths.max()))):
        on = np.flatnonzero(lengths > k)
        at = first[on] + k
        ends[at], entries[at] = end[on], back[at, end[on]]
        end[on] = entries[at]
    return entries, ends


def matched(points: DataFrame, edges: DataFrame, keys: list[str], order: str = "idx", sigma: float = 10.0, beta: float = 15.0, most: int = 5, point: str = "event_id", size: int = 512, bucket: int = 50_000) -> DataFrame:
    """Most likely road positions per track: candidates by the grid join, Viterbi by blocks of ``size`` steps.

    Blocks are tasks' work, not tracks: first each block's max-plus matrix from
    its first step's candidates to its last one's, then a short walk over a
    track's matrices, then each block's path between the two candidates that
    the walk has chosen. Tracks are walked many at once. Blocks of about ``bucket`` rows are advanced side by
    side. Scores are whole numbers and ties are broken by the same rule for
    every ``size``, so the path does not depend on it.
    """
    placed = numbered(saved(points.select(*keys, point, order, "x", "y"), "track-points"), keys, [order, point], "_step", "_n")
    found = saved(candidates(placed, edges, sigma, most, point), "track-candidates")
    last = F.greatest(F.col("_n") - 2, F.lit(0))  # the block of a step and, at a block's first step, the one before
    at = F.floor(F.least(F.col("_step"), last) / size)
    rows = found.withColumn("_block", F.explode(F.when((F.col("_step") % size == 0) & (F.col("_step") > 0) & (F.col("_step") <= last), F.array(at - 1, at)).otherwise(F.array(at))))
    many = max(1, -(-rows.count() // bucket))
    rows = rows.withColumns({"_bucket": F.pmod(F.xxhash64(*keys, "_block"), F.lit(many)), "_at": (F.col("_step") - F.col("_block") * size).cast("int")})
    names = [*keys, "_block"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    declared = ", ".join(f"{c} {types[c]}" for c in names)

    def numbered_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(_run=pdf.groupby(names, dropna=False, sort=False).ngroup())

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, c, steps, ok, _ = _packed(numbered_runs(pdf))
        score, tie = products(c, steps, ok, (runs["_block"] == 0).to_numpy(), sigma, beta)
        full = lambda m, fill: np.pad(m, ((0, 0), (0, most - m.shape[1]), (0, most - m.shape[2])), constant_values=fill).reshape(len(m), -1).tolist()
        return runs[names].assign(score=full(score, _NEVER), tie=full(tie, most * most))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, "_block"])
        lengths = np.bincount(pdf.groupby(keys, dropna=False, sort=False).ngroup())
        square = lambda c: np.stack(pdf[c]).astype(np.int64).reshape(-1, most, most)
        entries, ends = walked(square("score"), square("tie"), lengths)
        return pdf[names].assign(_entry=entries, _end=ends)

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = numbered_runs(pdf)
        runs, c, steps, ok, (run, t, k) = _packed(pdf)
        n = ok.shape[2]
        start = np.where(np.arange(n) == runs["_entry"].to_numpy()[:, None], 0, _NEVER)[:, None]
        _, back = forward(c, steps, ok, start, sigma, beta)
        path = traced(back, runs["_end"].to_numpy(np.int8)[:, None, None])[:, :, 0, 0]
        own = (path[t, run] == k) & ((t < size) | (pdf["_step"] == pdf["_n"] - 1).to_numpy())  # a shared step is the later block's
        return pdf.loc[own, [*keys, point, order, "edge", "px", "py"]]

    matrices = dealt(rows, "_bucket").groupBy("_bucket").applyInPandas(multiply, f"{declared}, score array<long>, tie array<long>")
    tracks = matrices.withColumn("_tracks", F.pmod(F.xxhash64(*keys), F.lit(many)))
    chosen = saved(dealt(tracks, "_tracks").groupBy("_tracks").applyInPandas(walk, f"{declared}, _entry int, _end int"), "track-blocks")
    both = rows.alias("r").join(chosen.alias("c"), reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in names])).select("r.*", "c._entry", "c._end")
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, point, order, "edge", "px", "py"))
    return dealt(both, "_bucket").groupBy("_bucket").applyInPandas(follow, schema)
