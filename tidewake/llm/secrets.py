"""Secret scan with corpus-wide ownership frequency. DataFrame operations only.

Every text is scanned once for each kind of candidate that its literal parts
do not rule out. A candidate's value is hashed, and the hashes are aggregated
over the corpus: in how many distinct repositories and with how many distinct
owners does a value occur? A value that ``COPIED`` owners or more share, or
that lies in ``SPREAD`` repositories or more, whoever owns them, is a widely
copied example; one that stays with fewer of both looks live. Candidates of the
base kinds are always reported; those of the loose kinds only where their
frequency says live.

Plain values never leave the scan: the tables that are shuffled or written
hold hashes and positions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, saved

#: A value with so many owners is a copied example,
COPIED = 3
#: and so is one in so many repositories, also of a single owner.
SPREAD = 4


@dataclass(frozen=True)
class Kind:
    """A candidate pattern (Java syntax, no groups but non-capturing ones).

    ``value`` extracts a match's secret as group 1; matches whose value has
    fewer than ``least`` characters, or lacks one of ``needs``, are dropped.
    Every match holds one of ``hints``, letters in either case; a text without
    any is not searched. No match begins after a character of the class
    ``after``: a pattern whose first part runs over such characters would
    otherwise be tried anew at every place of one long run.
    """

    name: str
    pattern: str
    least: int
    value: str = ""
    base: bool = False
    needs: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    after: str = ""

    @property
    def search(self) -> str:
        return f"(?<!{self.after}){self.pattern}" if self.after else self.pattern


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(x) for x in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
_ASSIGN = f"(?:{_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=-]+"

#: In the order in which spans of equal start are listed.
KINDS = (
    Kind("assign", _ASSIGN + _VALUE, 12, f"^{_ASSIGN}({_VALUE})$", True, hints=("passw", "secret", "token", "key")),
    Kind("access", "AKIA[A-Z0-9]{14,}", 18, base=True, hints=("akia",)),
    Kind("hex", "[0-9a-f]{16,}", 16, base=True),
    Kind("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 26, hints=("eyj",), after="[A-Za-z0-9_-]"),
    Kind("issued", "(?:gh[opsu]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{16,})", 16, hints=("gho_", "ghp_", "ghs_", "ghu_", "xox", "sk_live_", "glpat-")),
    Kind("bearer", "(?:[Bb]earer|[Bb]asic)\\x20+[A-Za-z0-9+/_.=-]{16,}", 16, "\\x20([^\\x20]+)$", needs=("[0-9]", "[A-Za-z]"), hints=("earer ", "asic ")),
    Kind("login", "://[^\\s/:@]+:[^\\s/:@]{6,}@", 6, ":([^:@]+)@$", hints=("://",)),
    Kind("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----\\s+[A-Za-z0-9+/=\\s]{40,}", 40, "KEY-----\\s+([A-Za-z0-9+/=\\s]+)$", hints=("-----begin ",)),
    Kind("mixed", "[A-Za-z0-9+/_-]{24,}", 24, needs=("[0-9].*[0-9]", "[A-Z].*[A-Z]", "[a-z].*[a-z]")),
)

_NONE = "array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean,hash:string>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` bound as a lambda's variable, so that it is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _blocks(values: Column) -> Column:
    """An array cut into blocks of about the square root of its size (an empty one is one empty block)."""
    width = F.greatest(F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"), F.lit(1))
    last = F.greatest(F.ceil(F.size(values) / width).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * width + 1, width))


def running(values: Column, plus) -> Column:
    """From 0 on, ``plus`` carried over an array of longs; one result for each element.

    It runs inside blocks and over the blocks, so that no growing list is
    copied at every element.
    """
    zero = F.lit(0).cast("long")

    def grown(first: Column, part: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda s, x: _bound(plus(s["at"], x), lambda at: F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out")))
        return F.aggregate(part, state, step, lambda s: s["out"])

    def over(blocks: Column) -> Column:
        before = grown(zero, F.transform(blocks, lambda x: F.aggregate(x, zero, plus)))
        return _bound(before, lambda b: F.flatten(F.transform(blocks, lambda x, k: grown(F.when(k == 0, zero).otherwise(F.get(b, k - 1)), x))))

    return _bound(_bound(values, _blocks), over)


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with its ``spans`` (sorted by start) replaced by ``mark``, those that overlap together.

    Positions count code points from the text's begin, and finding one costs a
    walk to it: the text is first cut into blocks of spans, then inside them.
    """
    tail = F.struct(F.length(text).cast("long").alias("start"), F.lit(True).alias("last"))
    cuts = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(False).alias("last"))), F.array(tail))
    reach = F.concat(F.array(F.lit(0).cast("long")), running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)))
    marked = F.zip_with(cuts, reach, lambda c, at: F.struct(c["start"].alias("start"), c["last"].alias("last"), at.alias("at")))

    def block(part: Column) -> Column:
        base = part[0]["at"]
        own = F.substring(text, base.cast("int") + 1, (F.array_max(F.transform(part, lambda c: c["start"])) - base).cast("int"))
        return _bound(own, lambda x: F.array_join(F.transform(part, lambda c: F.when((c["start"] < c["at"]) & ~c["last"], "").otherwise(
            F.concat(F.substring(x, (c["at"] - base).cast("int") + 1, (c["start"] - c["at"]).cast("int")), F.when(c["last"], "").otherwise(mark))
        )), ""))

    return F.array_join(F.transform(_bound(marked, _blocks), block), "")


def candidates(text: Column, kind: Kind, rank: int) -> Column:
    """All matches of one kind, leftmost and non-overlapping, as structs with code-point positions.

    The pieces between matches give the starts: a match ends where all pieces
    and matches up to it end.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(kind.search), F.lit(0)), F.split(text, kind.search, -1)

    def placed(matches: Column) -> Column:
        stops = running(F.zip_with(gaps, matches, lambda gap, hit: F.when(hit.isNotNull(), F.length(gap).cast("long") + F.length(hit)).otherwise(0)), lambda a, b: a + b)
        return F.zip_with(matches, stops, lambda hit, stop: F.struct(hit.alias("hit"), stop.alias("stop")))

    def value(x: Column) -> Column:
        return F.regexp_extract(x["hit"], kind.value, 1) if kind.value else x["hit"]

    def fit(x: Column) -> Column:
        return _bound(value(x), lambda v: reduce(lambda a, need: a & v.rlike(need), kind.needs, F.length(v) >= kind.least))

    def span(x: Column) -> Column:
        return F.struct(
            (x["stop"] - F.length(x["hit"])).alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("end"),
            F.lit(kind.name).alias("kind"), F.lit(kind.base).alias("base"), F.sha2(value(x), 256).alias("hash"),
        )

    found = F.transform(F.filter(F.filter(_bound(hits, placed), lambda x: x["hit"].isNotNull()), fit), span)
    return F.when(text.rlike(kind.search), found).otherwise(F.array().cast(_NONE))


def scanned(docs: DataFrame, text_col: str = "text", kinds=KINDS) -> DataFrame:
    """``docs`` with ``hits``: every candidate of every kind; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.lower(text)  # a prefilter's form only, never a match's
    none = F.array().cast(_NONE)

    def searched(kind: Kind, rank: int) -> Column:
        found = candidates(text, kind, rank)
        return F.when(reduce(lambda a, b: a | b, [low.contains(h) for h in kind.hints]), found).otherwise(none) if kind.hints else found

    return docs.withColumn("hits", F.concat(*[searched(k, rank) for rank, k in enumerate(kinds)]))


def ownership(hits: DataFrame) -> DataFrame:
    """(``hash``, ``owners``, ``repositories``, ``n``) from rows (``hash``, ``owner``, ``repository``).

    Three grouped counts, each combined before its shuffle; null owners and
    repositories count as one of their own. ``n`` counts the rows.
    """
    places = hits.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = places.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def is_live(owners: Column, repositories: Column, copied: int = COPIED, spread: int = SPREAD) -> Column:
    """Whether a value found with so many owners and repositories looks like someone's own."""
    return (owners < copied) & (repositories < spread)


def judged(found: DataFrame, row: str, copied: int = COPIED, spread: int = SPREAD) -> DataFrame:
    """Per ``row`` its reported ``spans``, sorted, each with ``live``; ``found`` has row, owner, repository, hits."""
    hits = found.select(row, "owner", "repository", F.explode("hits").alias("hit")).select(row, "owner", "repository", "hit", F.col("hit.hash").alias("hash"))
    known = saved(ownership(hits), "secret-owners")
    rated = looked_up(hits.select(row, "hit", "hash"), known, ["hash"], "n").withColumn("live", is_live(F.col("owners"), F.col("repositories"), copied, spread))
    spans = rated.where(F.col("hit.base") | F.col("live")).select(row, F.struct("hit.start", "hit.rank", "hit.end", "hit.kind", "hit.base", "live", "owners", "repositories").alias("span"))
    return spans.groupBy(row).agg(F.sort_array(F.collect_list("span")).alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, kinds=KINDS, copied: int = COPIED, spread: int = SPREAD) -> DataFrame:
    """One row per input row: ``id_col`` and ``spans`` (array of structs, by start, then kind as listed).

    Null and empty texts have no spans; repeated rows are each reported (and
    are one owner's, so no copies); an empty table gives no row; other columns
    are ignored. Texts are scanned whole, in time in proportion to their length
    (no pattern is tried more than once in a run of characters that its first
    part takes); a text of n matches costs about n^1.5 small steps more.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    narrow = docs.select(F.col(id_col).alias("id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.col(text_col).alias("text"))
    found = scanned(narrow, "text", kinds).select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", "hits")
    found = saved(found, "secret-hits")
    some = found.where(F.size("hits") > 0)
    spans = judged(some, "row", copied, spread)
    kind = spans.schema["spans"].dataType
    none = found.where(F.size("hits") == 0).select("id", F.array().cast(kind).alias("spans"))
    known = some.select("row", "id").join(spans, "row", "left").select("id", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    return none.unionByName(known).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", owner: Column | None = None, repository: Column | None = None, kinds=KINDS, copied: int = COPIED, spread: int = SPREAD, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live span of a text replaced by ``mark``; rows without one stay as they are.

    Widely copied examples stay. Overlapping spans are replaced together. Null
    and empty texts stay null and empty, repeated rows are each cleaned, an
    empty table gives no row, and other columns keep their names and values
    whatever these are. Texts of any length are scanned once, whole.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(text_col).alias("text"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
    rated = saved(scanned(whole, "text", kinds).drop("text").withColumn("row", F.monotonically_increasing_id()), "secret-docs")
    some = rated.where(F.size("hits") > 0)
    live = judged(some.select("row", "owner", "repository", "hits"), "row", copied, spread).select("row", F.filter("spans", lambda s: s["live"]).alias("spans"))
    live = saved(live.where(F.size("spans") > 0), "secret-live")
    text = F.col(f"doc.`{text_col}`").cast("string")
    clean = F.when(F.col("spans").isNull(), text).otherwise(replaced(text, F.col("spans"), mark))
    marked = some.select("row", "doc").join(live, "row", "left").select("doc", clean.alias("clean"))
    changed = marked.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in names])
    same = rated.where(F.size("hits") == 0).select(*[F.col(f"doc.`{c}`").alias(c) for c in names])
    return same.unionByName(changed)
