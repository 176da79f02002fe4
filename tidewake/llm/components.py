"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minimums, combined before their shuffle, and two
look-ups of a node's minimum by its links. The nodes with most links take
theirs from a broadcast of bounded size and pass through the join under a key
of their own, so a hub's neighbours are never gathered in one task. Each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAD, drop_saved, saved


def _star(links: DataFrame, large: bool, head: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else links
    least = both.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("n")).select("src", F.least("src", "low").alias("low"), "n")
    hubs = least.orderBy(F.desc("n"), "src").limit(head).select("src", F.col("low").alias("hub"))
    marked = both.join(F.broadcast(hubs), "src", "left").withColumn("away", F.when(F.col("hub").isNull(), 0).otherwise(1 + F.pmod(F.hash("dst"), 1024)))
    near = marked.join(least.select("src", "low", F.lit(0).alias("away")), ["src", "away"], "left").select("src", "dst", F.coalesce("hub", "low").alias("low"))
    if large:  # larger neighbours of a node point to its smallest neighbour
        return near.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    moved = near.where(F.col("dst") != F.col("low")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select("src", F.col("low").alias("dst")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first())


def components(links: DataFrame, head: int = HEAD) -> DataFrame:
    """(``node``, ``root``) for every node that a link (``src``, ``dst``: long) touches; roots are left out.

    Rounds go on until nothing changes, some log(n) of them. Null ends are
    ignored, repeated links and links to oneself change nothing, and no links
    give no row.
    """
    links = links.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    links = saved(links, "links")
    state = _state(links)
    while True:
        new = saved(_star(_star(links, True, head).distinct(), False, head).distinct(), "links")
        drop_saved(links)
        links, old = new, state
        state = _state(links)
        if state == old:
            return links.select(F.col("src").alias("node"), F.col("dst").alias("root"))
