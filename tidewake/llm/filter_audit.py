"""How quality filters interact: what each removes alone, after others, and on average over all orders.

A relational word pipeline. Texts are dealt by document, words are exploded
and aggregated by (document, word), then by document for totals and distinct
words. The other flags (capitals, symbols, copies) join them, every document
gets the set of filters that it fails, and one aggregation a part counts the
32 sets in conditional columns: all rows, good ones, toxic ones. Whatever
order the filters run in follows from these counts.

A document's key is its id with the SHA-256 of its text, so repeated ids do
not mix. Texts are shuffled once, words not at all: the explode and both word
aggregations keep the texts' partitioning.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, saved

#: A: too few words. B: too few distinct words. C: too many capitals. D: holds a symbol. E: copies a smaller id's text.
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
SETS = 1 << len(FILTERS)


def word_counts(docs: DataFrame) -> DataFrame:
    """(``id``, ``digest``, ``total``, ``distinct``) of ``docs`` (id, text: no nulls), one row for each pair of id and text.

    Every row also gives one null word, so that a text without words has a
    row, and copies of a row are counted.
    """
    texts = docs.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), "text").repartition("id", "digest")
    words = texts.select("id", "digest", F.explode(F.concat(F.split("text", SPACE), F.array(F.lit(None).cast("string")))).alias("word"))
    pairs = words.where(F.col("word").isNull() | (F.col("word") != "")).groupBy("id", "digest", "word").agg(F.count("*").alias("n"))
    copies = F.max(F.when(F.col("word").isNull(), F.col("n")))
    return pairs.groupBy("id", "digest").agg((F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)) / copies).cast("long").alias("total"), F.count("word").alias("distinct"))


def other_flags(docs: DataFrame) -> DataFrame:
    """(``id``, ``digest``, ``part``, ``c``, ``d``, ``rows``, ``e``) of ``docs`` (id, part, text: no nulls in part and text)."""
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    flags = docs.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), "part", (capitals * 100 > F.length("text") * MOST_CAPITALS).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    flags = saved(flags.groupBy("id", "digest", "part", "c", "d").agg(F.count("*").alias("rows")), "audit-flags")
    firsts = flags.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return looked_up(flags, saved(firsts, "audit-firsts"), ["digest"], "n").select("id", "digest", "part", "c", "d", "rows", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)).alias("e"))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(``part``, ``fails``, ``good``, ``toxic``, ``rows``): so many ``rows`` of one document fail the filters of the bit set ``fails``.

    Bit k is filter k of :data:`FILTERS`. A null text is empty, a null part
    the empty string. A null id has no smaller one, is no one's smaller one and
    has no labels; repeated rows of one id are no copies of each other. Of
    several labels of one id any that says 1 counts.
    """
    column = lambda c: F.col(f"`{c}`")
    rows = docs.select(column(id_col).alias("id"), F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    flags, counts = other_flags(rows), word_counts(rows.select("id", "text"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    named = flags.where(F.col("id").isNotNull()).join(known, "id", "left")
    nameless = flags.where(F.col("id").isNull()).withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    f, w = named.unionByName(nameless).alias("f"), counts.alias("w")
    met = f.join(w, F.col("f.id").eqNullSafe(F.col("w.id")) & (F.col("f.digest") == F.col("w.digest")), "full_outer")
    total, distinct = F.coalesce("w.total", F.lit(0)), F.coalesce("w.distinct", F.lit(0))
    flagged = (total < LEAST_WORDS, distinct * 100 < total * LEAST_DISTINCT, F.col("f.c"), F.col("f.d"), F.col("f.e"))
    fails = sum((F.when(flag, 1 << k).otherwise(0) for k, flag in enumerate(flagged)), F.lit(0))
    return met.select("f.part", fails.alias("fails"), F.coalesce("f.good", F.lit(False)).alias("good"), F.coalesce("f.toxic", F.lit(False)).alias("toxic"), "f.rows")


def counted(failed: DataFrame) -> DataFrame:
    """One row a part with the arrays ``all``, ``good`` and ``toxic``: how many rows fail each of the 32 sets."""
    of = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    columns = {name: [f"{name}_{s}" for s in range(SETS)] for name in of}
    sums = [F.coalesce(F.sum(F.when((F.col("fails") == s) & of[name], F.col("rows"))), F.lit(0)).alias(c) for name in of for s, c in enumerate(columns[name])]
    wide = failed.groupBy("part").agg(*sums)
    return wide.select("part", *[F.array(*columns[name]).alias(name) for name in of])


def _sum(counts: str, keep) -> Column:
    """The sum over the sets s that ``keep`` takes, each counted as often as ``keep`` says (a bool or a number)."""
    return F.aggregate(F.transform(counts, lambda n, s: n * keep(s).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def orders(parts: DataFrame) -> DataFrame:
    """Every order of the filters and every step of it, for each row of :func:`counted`."""
    every = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    letters = F.split("filter_order", "")
    bit = lambda x: F.pow(F.lit(2), F.instr(F.lit(FILTERS), x) - 1).cast("int")
    rows = parts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("before", F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + bit(x)))
    rows = rows.withColumn("own", bit(F.get(letters, F.col("step") - 1)))
    meets = lambda s, c: s.bitwiseAND(F.col(c)) != 0
    removed = lambda s: meets(s, "own") & ~meets(s, "before")
    return rows.select(
        "part", "filter_order", "step",
        _sum("all", lambda s: ~meets(s, "own") & ~meets(s, "before")).alias("kept"),
        _sum("all", removed).alias("removed"),
        _sum("all", lambda s: meets(s, "own") & meets(s, "before")).alias("redundant"),
        _sum("all", lambda s: s == F.col("own")).alias("unique_fails"),
        _sum("good", removed).alias("good_lost"),
        _sum("toxic", removed).alias("toxic_lost"),
        # of a set's filters each comes first in as many of the 120 orders
        _sum("all", lambda s: F.when(meets(s, "own"), F.lit(120) / F.bit_count(s)).otherwise(0)).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per part, order and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``.

    Odd rows are as in :func:`failures`; a part without rows has none, an
    empty table gives no row, other columns are ignored, and texts of any
    length are read whole.
    """
    return orders(saved(counted(failures(docs, labels, id_col, part_col, text_col)), "audit-sets"))
