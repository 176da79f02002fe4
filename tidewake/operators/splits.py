"""Groups, splits and set operations on drives."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mapped(df: DataFrame, key: str, groups: dict, out: str) -> DataFrame:
    """A small literal mapping as a column; unknown keys are null."""
    pairs = [x for k, v in groups.items() for x in (F.lit(k).cast(df.schema[key].dataType), F.lit(v))]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(key)))


def split_drives(drives: list[str], ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42, shuffle: bool = True, least: int = 1) -> dict[str, list[str]]:
    """Disjoint train, val and test lists; fewer than three drives all train, none is an error. For lists; tables take :func:`split_table`."""
    unique = list(dict.fromkeys(drives))
    if not unique:
        raise ValueError("no drives to split")
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    if len(unique) < 3:
        return {"train": unique, "val": [], "test": []}
    if shuffle:
        random.Random(seed).shuffle(unique)
    train, val = split_sizes(len(unique), ratios, least)
    return {"train": unique[:train], "val": unique[train : train + val], "test": unique[train + val :]}


def split_sizes(n: int, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), least: int = 1) -> tuple[int, int]:
    """How many of ``n`` drives train and validate; where train would fall short, val gives one up, then test."""
    if n < 3:
        return n, 0
    val, test = (max(least, round(n * r)) for r in ratios[1:])
    for _ in range(2):
        if n - val - test < least:
            val, test = (max(1, val - 1), test) if _ == 0 else (val, max(1, test - 1))
    if n - val - test < 1:
        val, test = (val, test - 1) if test > 1 else (max(1, val - 1), test)
    return max(1, n - val - test), val


def split_table(df: DataFrame, key: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42, least: int = 1) -> DataFrame:
    """(``key``, ``split``) for every distinct key, in the order of a seeded hash; the counts follow :func:`split_sizes`.

    Ranks need no global sort: keys are numbered inside the 65,536 buckets of
    their hash's first digits and shifted by the buckets before; only the
    buckets' counts are ordered together.
    """
    keys = df.select(key).distinct().withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    keys = keys.withColumn("_bucket", F.substring("_hash", 1, 4))
    counts = keys.groupBy("_bucket").agg(F.count("*").alias("_n"))
    n = counts.agg(F.sum("_n")).first()[0] or 0
    train, val = split_sizes(n, ratios, least)
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash")) + F.col("_before")
    ranked = keys.join(before, "_bucket").withColumn("_rank", rank)
    return ranked.select(key, F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + val, "val").otherwise("test").alias("split"))


def shared_members(splits: DataFrame, member: str = "member", split: str = "split") -> DataFrame:
    """Members of more than one split; an empty result is a clean split."""
    return splits.groupBy(member).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def require_disjoint(splits: DataFrame) -> None:
    found = shared_members(splits).limit(5).collect()
    if found:
        raise ValueError(f"members of several splits: {[tuple(r) for r in found]}")
