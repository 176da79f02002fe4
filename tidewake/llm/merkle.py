"""Merkle manifest of a dataset: bottom-up build, top-down proof push.

Every row is a leaf, the leaves of a group (a source) make a tree in id order,
and the groups' roots make one more tree, whose root stands for the dataset.
Building goes bottom-up: runs of ``FAN`` neighbours are grouped under their
parent's number, level by level, and every level is written to the shared
folder. Proofs go top-down: a level's children join their parents and prepend
their own siblings to the proof that the parent has inherited.

No step holds a group whole: leaves are numbered by sorted ranges and prefix
counts, a run has at most three members, and the joins' keys are (group,
parent), of which none has more than three rows. A dataset of n rows takes
about log3(n) rounds each way over geometrically shrinking tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import drop_saved, saved

FAN = 3
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:binary,right:binary>>"


def described(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value (integers in decimal)."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """The leaf's SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[described(c) for c in fields]), 256))


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _of(digests: Column) -> Column:
    """SHA-256 of digests as hex text, one after the other."""
    return F.unhex(F.sha2(as_text(digests), 256))


@dataclass
class Tree:
    """``levels``: from the leaves up, tables (group, i, n, digest, kids), n being the nodes of the group's
    level; ``roots``: (group, level, digest), one row for each group."""

    levels: list[DataFrame]
    roots: DataFrame


def build(leaves: DataFrame) -> Tree:
    """The tree of every group of ``leaves`` (group, i, n, digest: 32 bytes, further columns): i counts from 0, n is the group's size.

    While a group has several nodes, every three consecutive ones (at the end
    fewer) give way to the digest of theirs. A null group is a group. An empty
    table has one empty level and no root.
    """
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = levels[-1].where(F.col("n") > 1)
        runs = level.groupBy("group", F.floor(F.col("i") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("run"), F.ceil(F.max("n") / FAN).alias("n"))
        kids = F.transform("run", lambda k: k["digest"])
        above = runs.select("group", F.col("up").alias("i"), "n", kids.alias("kids")).withColumn("digest", _of(_joined(F.col("kids"))))
        levels.append(saved(above, "merkle-level"))
        most = -(-most // FAN)
    roots = [x.where(F.col("n") == 1).select("group", F.lit(k).alias("level"), "digest") for k, x in enumerate(levels)]
    return Tree(levels, saved(reduce(DataFrame.unionByName, roots), "merkle-roots"))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, b: F.concat(a, b))


def push(tree: Tree, inherited: DataFrame) -> DataFrame:
    """The leaves of ``tree`` with ``subroot`` and ``proof``, a step (``left``, ``right``) for each level up to the root.

    ``inherited`` holds the proof of every group's root (group, proof). A step
    has the siblings left and right of the node, concatenated.
    """
    roots, tops = tree.roots.alias("r"), inherited.alias("h")
    tops = roots.join(tops, F.col("r.group").eqNullSafe(F.col("h.group"))).select("r.group", "r.level", F.col("r.digest").alias("subroot"), "h.proof")
    tops = saved(tops, "merkle-tops")
    above = None
    for k in reversed(range(len(tree.levels))):
        level = tree.levels[k]
        extra = [c for c in level.columns if c not in ("group", "i", "n", "digest")]
        c, t = level.where(F.col("n") == 1).alias("c"), tops.where(F.col("level") == k).alias("t")
        own = c.join(t, F.col("c.group").eqNullSafe(F.col("t.group"))).select("c.*", "t.subroot", "t.proof")
        if above is not None:
            c, p = level.where(F.col("n") > 1).alias("c"), above.alias("p")
            met = c.join(p, F.col("c.group").eqNullSafe(F.col("p.group")) & (F.floor(F.col("c.i") / FAN) == F.col("p.i")))
            at = (F.col("c.i") % FAN).cast("int")
            side = lambda x: _joined(x)
            step = F.struct(side(F.slice("p.kids", F.lit(1), at)).alias("left"), side(F.slice("p.kids", at + 2, F.lit(FAN))).alias("right"))
            own = own.unionByName(met.select("c.*", "p.subroot", F.concat(F.array(step), F.col("p.proof")).alias("proof")))
        below = own.select("group", "i", *extra, *(["digest"] if k == 0 else []), "subroot", "proof")
        above, done = (saved(below, "merkle-proofs") if k else below), above
        if done is not None and k:
            drop_saved(done)
    return above


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda at, step: _of(F.concat(step["left"], at, step["right"])))


def proof_digest(proof: Column) -> Column:
    """SHA-256 (hex) over all siblings as hex text, from the leaf's own to the root's, each run left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: as_text(F.concat(s["left"], s["right"]))), ""), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, found: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``leaf``, ``found``, ``group``, ``subroot``, ``root`` (32 bytes) and ``proof``.

    ``fields`` make up the leaf. ``found`` gives fields as they are found now,
    where these may differ from what was signed: the column ``found`` is the
    leaf of these, ``leaf`` that of the original.

    Null fields are ``-``; null ids come first in their group, a null group is
    one of its own and comes first; rows of equal ids are ordered by their
    leaf, so the manifest does not depend on the input's order; repeated rows
    are leaves of their own. A group of one is its own subroot, a dataset of
    one group has that group's root. An empty table gives no row; other
    columns are ignored.
    """
    column = lambda c: F.col(f"`{c}`")
    now = found or {}
    parts = [column(c) for c in fields]
    rows = docs.select(column(id_col).alias("id"), column(group_col).cast("string").alias("group"), leaf(parts).alias("digest"), leaf([now.get(c, column(c)) for c in fields]).alias("found"), F.monotonically_increasing_id().alias("row"))
    leaves = numbered(saved(rows, "merkle-leaves"), ["group"], ["id", "digest", "row"], "i")
    tree = build(saved(leaves.drop("row"), "merkle-level"))
    subroots = tree.roots.select(F.lit("").alias("group"), F.col("group").alias("of"), "digest")
    top = build(saved(numbered(subroots, ["group"], ["of"], "i"), "merkle-level"))
    first = top.roots.first()
    above = push(top, top.roots.select("group", F.array().cast(_STEPS).alias("proof")))
    proved = push(tree, above.select(F.col("of").alias("group"), "proof"))
    root = F.lit(bytes(first["digest"]) if first else None).cast("binary")
    return proved.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "found", "group", "subroot", root.alias("root"), "proof")


def verify(rows: DataFrame, digest: str = "found") -> DataFrame:
    """``rows`` of :func:`manifest` with ``folded_root``, recomputed from column ``digest`` and the proof, and ``verified``."""
    return rows.withColumn("folded_root", folded(F.col(digest), F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))
