"""Random numbers that follow from a seed and a row's own keys, whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def drawn(seed: int, name: str, *keys) -> Column:
    """A number in (0, 1) that follows from the seed and the row's own keys, not from its place among partitions."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(1 << 53).cast("long")) + 0.5) / float(1 << 53)


def normal(seed: int, name: str, *keys) -> Column:
    """A standard normal number of the same kind (Box and Muller)."""
    return F.sqrt(-2 * F.log(drawn(seed, name + "|u", *keys))) * F.cos(2 * math.pi * drawn(seed, name + "|v", *keys))
