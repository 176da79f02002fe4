"""Row numbers inside groups of any size: range partitions and prefix counts, no window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "idx", total: str = "n") -> DataFrame:
    """``df`` with each row's place in its group (from 0, by ``order``) and the group's size.

    Rows are dealt into sorted ranges of (group, order), so that a group that
    holds most rows spreads over many tasks, and written once: the counts of
    the ranges then shift the places inside them. Nulls come first. ``df`` is
    read twice (the ranges are sampled), so it should be a table. Ties in
    ``order`` take any order among themselves, but a run of equal keys is one
    task's: end ``order`` with a column that tells rows apart.
    """
    keys = [*group, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = saved(dealt, "numbering").withColumn("_part", F.shiftright("_at", 33))
    parts = dealt.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    inside = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # a row for each range, not for each row
    parts = parts.withColumns({"_before": F.sum("_n").over(inside.orderBy("_part")) - F.col("_n") - F.col("_first"), total: F.sum("_n").over(inside)})
    parts = saved(parts, "numbering-parts").select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "_before", total)
    same = dealt["_part"] == parts["_p"]
    for k, g in enumerate(group):
        same &= dealt[g].eqNullSafe(parts[f"_g{k}"])
    rows = dealt.join(parts, same)
    return rows.select(*[dealt[c] for c in df.columns], (F.col("_at") + F.col("_before")).alias(name), F.col(total))
