"""URL filter: host and path rules, else a character language-model ratio. DataFrame operations only.

URLs that a rule decides teach two variable-order Markov models, one of
accepted and one of rejected URLs. A character's probability after its
``ORDER - 1`` predecessors mixes all shorter contexts: with counts n and
context totals N, P_k = (n_k + MIX * P_(k-1)) / (N_k + MIX), from P_0 = 1 /
ALPHABET; a context that was never seen hands over to the shorter one. A URL's
score is the mean, over its characters and an end mark, of the log ratio of
the two probabilities. The threshold between allow and block lies between the
mean scores of held-back accepted and rejected URLs, weighted by their spread.

A character's log ratio depends on its window of ``ORDER`` characters alone, so
the models are evaluated once per distinct window, and a URL's characters
meet them in one join on the window. Some windows stand in almost every URL,
some characters in almost every window and some URLs on many pages: such keys
take their facts from a broadcast of bounded size (``looked_up``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_saved, looked_up, saved

ORDER = 5
MIX = 2.0
ALPHABET = 256
START, END = "\x02", "\x03"
#: One in HOLD of the URLs that a rule decides only sets the threshold.
HOLD = 5

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or a text without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(((host == h) | host.endswith(f".{h}")) & path.startswith(p), h + p, v) for v, h, p in ordered]
    pick = lambda k: reduce(lambda rest, x: F.when(x[0], F.lit(x[k])).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
    return pick(1), pick(2)


def windows(url: Column) -> Column:
    """One window of ORDER characters for each character and the end mark."""
    chars = F.split(F.concat(F.lit(START * (ORDER - 1)), ascii_lower(F.coalesce(url, F.lit(""))), F.lit(END)), "")
    # bound as a lambda's variable, the characters are split off once and not for every window
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - ORDER), lambda i: F.concat(*[F.get(c, i + k) for k in range(ORDER)]))
    return F.transform(F.array(chars), cut)[0]


def _count(label: str) -> Column:
    return F.sum(F.when((F.col("verdict") == label) & ~F.col("held"), 1).otherwise(0)).alias(label)


def log_ratios(positions: DataFrame) -> DataFrame:
    """(``window``, ``ratio``, ``n``) for every distinct window of ``positions`` (window, verdict, held); ``n`` counts its places."""
    seen = saved(positions.groupBy("window").agg(_count("allow"), _count("block"), F.count("*").alias("n")), "url-windows")
    grams = seen.select("window", "n", "allow", "block", F.explode(F.array(*map(F.lit, range(1, ORDER + 1)))).alias("k"))
    grams = grams.withColumn("gram", F.substring("window", ORDER + 1 - F.col("k"), F.col("k")))
    counts = grams.groupBy("k", "gram").agg(F.sum("allow").alias("a"), F.sum("block").alias("b"), F.count("*").alias("places")).withColumn("context", F.substring("gram", F.lit(1), F.col("k") - 1))
    counts = saved(counts, "url-grams")
    totals = counts.groupBy("k", "context").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("grams"))
    model = saved(looked_up(counts, totals, ["k", "context"], "grams").select("gram", "a", "ta", "b", "tb", "places"), "url-model")
    parts = looked_up(grams.select("window", "n", "k", "gram"), model, ["gram"], "places")
    at = lambda k, name: F.max(F.when(F.col("k") == k, F.col(name))).alias(f"{name}{k}")
    wide = parts.groupBy("window", "n").agg(*[at(k, n) for k in range(1, ORDER + 1) for n in ("a", "ta", "b", "tb")])

    def probability(n: str, total: str) -> Column:
        return reduce(lambda p, k: (F.col(f"{n}{k}") + MIX * p) / (F.col(f"{total}{k}") + MIX), range(1, ORDER + 1), F.lit(1.0 / ALPHABET))

    ratios = saved(wide.select("window", F.log(probability("a", "ta") / probability("b", "tb")).alias("ratio"), "n"), "url-ratios")
    for table in (seen, counts, model):
        drop_saved(table)
    return ratios


def threshold(scores: DataFrame) -> float:
    """Between the held-back classes' mean scores, nearer to the one with less spread; 0 if one is missing."""
    rows = {r["verdict"]: r for r in scores.where(F.col("held") & F.col("verdict").isNotNull()).groupBy("verdict").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
    if len(rows) < 2:
        return 0.0
    a, b = rows["allow"], rows["block"]
    spread = a["s"] + b["s"]
    return (a["m"] * b["s"] + b["m"] * a["s"]) / spread if spread > 0 else (a["m"] + b["m"]) / 2


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    ``score`` is the calibrated one (above 0: allow) and null where a rule
    decides. A null URL is judged as the empty text, repeated rows and equal
    URLs get equal verdicts, ties at the threshold are allowed; an empty table
    gives no row; other columns are ignored. Without rule-decided URLs of both
    kinds all scores are compared with 0. Each distinct URL teaches and is
    scored once, over its whole length.
    """
    known = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    known = known.withColumn("key", F.sha2("url", 256))
    host, path = host_path(F.col("url"))
    text, verdict = rule(F.col("host"), F.col("path"), rules)
    named = lambda df: df.withColumn("host", host).withColumn("path", path).withColumn("rule", text).withColumn("verdict", verdict)
    held = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 6), 16, 10).cast("long") % HOLD == 0
    distinct = known.groupBy("key").agg(F.first("url").alias("url"), F.count("*").alias("pages"))
    distinct = saved(named(distinct).select("key", "url", "pages", "rule", "verdict", held.alias("held")), "urls")
    positions = distinct.select("key", "verdict", "held", F.explode(windows(F.col("url"))).alias("window"))
    scored = looked_up(positions.select("key", "window"), log_ratios(positions), ["window"], "n").groupBy("key").agg(F.avg("ratio").alias("score"))
    scores = saved(distinct.select("key", "pages", F.col("verdict").alias("ruled"), "held").join(scored, "key"), "url-scores")
    level = threshold(scores.select(F.col("ruled").alias("verdict"), "held", "score"))
    judged = looked_up(named(known), scores.select("key", "score", "pages"), ["key"], "pages")
    score = F.when(F.col("rule").isNull(), F.col("score") - level)
    answer = F.coalesce("verdict", F.when(F.col("score") >= level, "allow").otherwise("block"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", answer.alias("verdict"), score.alias("score"))
