"""Toxicity by weak supervision.

From a bounded sample of labelled rows (``SAMPLE`` at most, in hash order)
words and word beginnings are mined that toxic rows share; each becomes a
lexicon voter that votes toxic where it occurs and abstains elsewhere. Pattern
voters look at how many distinct lexicon entries a text has, how dense they
are, shouting, exclamation and insults in the second person; some of them vote
clean. A generative label model learns from the votes alone how accurate the
voters are, and which of them say the same thing: voters that agree beyond
what the hidden label explains form a group, and a group has one table of how
many of its members fire given the label, so that their evidence is not
counted once for each. The model's posterior labels train a linear classifier.
The sample's own labels serve twice only, to mine the lexicon and to calibrate
the classifier: they set the scale of its margin (Platt) and its cut, so that
0.7 is the score with the best F1.

Mining is a grouped count of features over the sample; the driver receives the
``LEXICON`` strongest features and, for each sample row, which of them it has.
Scoring is one pass over the texts with the model's few hundred strings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, fold, payloads, saved, slices

#: At most so many labelled rows train the model.
SAMPLE = 8_000
LEXICON = 600
CUT = 0.7
#: Lengths in bytes of the word beginnings that are mined.
STEMS = (5, 6, 7, 8)
#: Distinct features that a mining task holds before it hands its counts on.
HELD = 400_000
#: Voters whose votes correlate more than this, beyond what the label explains, are a group.
ALIKE = 0.5
#: And more than this outright: a group from the start.
SAME = 0.9
#: The counts 0, 1, 2, 3-5, 6-11, 12-23, ... of a group's firing voters are told apart, in so many steps after 0.
MOST = 8
#: Twice the log-likelihood ratio from which a feature is no chance find among a million.
CHANCE = 28.0

_CLASSES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_SECOND_PERSON = re.compile(r"\byou (?:are|re) (?:a |an |so |such |all )?\w+|\bshut up\b|\bgo away\b")


def words(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(_CLASSES).split())


def features(found: set[bytes]) -> set[bytes]:
    """The words themselves and their beginnings, with a star for each of up to three words that share one."""
    out = set(found)
    for k in STEMS:
        for stem, n in Counter([w[:k] for w in found if len(w) >= k]).items():
            out.add(stem + b"*")
            if n > 1:
                out.add(stem + b"**")
                if n > 2:
                    out.add(stem + b"***")
    return out


def shape(text: str, n_words: int) -> tuple[float, ...]:
    """What the fixed patterns look at: shouting, exclamation marks a word, second-person insults."""
    upper = sum(map(str.isupper, text))
    return upper / max(1, len(text)), text.count("!") / max(1, n_words), float(bool(_SECOND_PERSON.search(text.lower())))


# -- label model ----------------------------------------------------------


@dataclass
class LabelModel:
    """Votes are 1 (toxic), 0 (clean) or -1 (abstains); voters of a group depend on each other, groups do not, given the label.

    A group's state is how many of its voters vote toxic, in steps that double,
    and whether any votes clean; ``tables`` holds P(state | clean), P(state | toxic)
    for each group.
    """

    prior: float = 0.1
    groups: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)

    def fit(self, votes: np.ndarray, rounds: int = 6) -> LabelModel:
        """Expectation-maximisation from the majority of the votes cast.

        Voters that say outright the same (correlation over ``SAME``) are one
        group from the start, so that they do not outvote the rest; the other
        groups are found from what a first fit leaves unexplained.
        """
        self.groups = _linked(votes, np.zeros(len(votes)), SAME)
        cast = [np.sign((votes[:, g] == 1).sum(1) - (votes[:, g] == 0).sum(1)) for g in self.groups]
        y = self._em(votes, np.where(np.sum(cast, 0) > 0, 0.9, 0.02), rounds)
        self.groups = _linked(votes, y, ALIKE, self.groups)
        self._em(votes, y, rounds)
        return self

    def _em(self, votes: np.ndarray, y: np.ndarray, rounds: int) -> np.ndarray:
        states = [group_states(votes[:, g]) for g in self.groups]
        for _ in range(rounds):
            self.prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
            self.tables = []
            for x in states:
                table = np.stack([np.bincount(x, w, 2 * MOST + 2) + 0.5 for w in (1 - y, y)])
                self.tables.append(table / table.sum(1, keepdims=True))
            y = self._posterior(states)
        return y

    def _posterior(self, states: list[np.ndarray]) -> np.ndarray:
        z = math.log(self.prior / (1 - self.prior))
        for x, table in zip(states, self.tables, strict=True):
            z = z + np.log(table[1] / table[0])[x]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._posterior([group_states(votes[:, g]) for g in self.groups])


def _linked(votes: np.ndarray, y: np.ndarray, least: float, groups: list[np.ndarray] = ()) -> list[np.ndarray]:
    """Connected voters: those whose votes, less what the label ``y`` explains, correlate above ``least``, or that share a group."""
    residual = np.array([1, -1, 0], np.float32)[np.where(votes == 1, 0, np.where(votes == 0, 1, 2))]
    y = y.astype(np.float32)
    mean = [w @ residual / max(float(w.sum()), 1e-9) for w in (1 - y, y)]
    for k in range(residual.shape[1]):
        residual[:, k] -= y * mean[1][k] + (1 - y) * mean[0][k]
    alike = residual.T @ residual
    size = np.sqrt(np.diag(alike)) + 1e-9
    linked = alike / size / size[:, None] > least
    for g in groups:
        linked[np.ix_(g, g)] = True
    root = np.arange(len(linked))
    while True:  # the smallest number among a voter's links, until it settles
        new = np.minimum(root, np.where(linked, root[None], len(root)).min(1, initial=len(root)))
        if (new == root).all():
            return [np.flatnonzero(root == r) for r in np.unique(root)]
        root = new


def group_states(votes: np.ndarray) -> np.ndarray:
    n = (votes == 1).sum(1)
    step = np.where(n < 3, n, np.floor(np.log2(np.maximum(n, 1) / 0.375)).astype(np.int64))
    return 2 * np.minimum(step, MOST) + (votes == 0).any(1)


def _pattern_votes(hits: np.ndarray, density: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    vote = lambda yes, no=None: np.where(yes, 1, np.where(no, 0, -1) if no is not None else -1)
    return np.stack([
        vote(hits >= 2, hits == 0), vote(hits >= 4), vote(hits >= 8), vote(density >= 0.01, density == 0), vote(density >= 0.03),
        vote(shapes[:, 0] >= 0.6), vote(shapes[:, 1] >= 0.3), vote(shapes[:, 2] > 0),
    ], 1)


def _dense(hits: np.ndarray, density: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(hits), np.minimum(density, 0.2) * 20, hits == 0, shapes])


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton's method on soft labels; the last weight is the intercept."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        curve, slope = np.diag(ridge), ridge * w
        for at in range(0, len(x), 1000):
            part = np.column_stack([x[at : at + 1000], np.ones(len(x[at : at + 1000]))]).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curve += (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
            slope += part.T @ (p - y[at : at + 1000])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: dict[bytes, float]
    dense: tuple[float, ...]
    intercept: float
    scale: float
    cut: float

    def score(self, text: str) -> float:
        found = words(text)
        every = features(found)
        hits = every & self.lexicon.keys()
        n = len(found)
        z = self.intercept + sum(self.lexicon[h] for h in sorted(hits))
        dense = _dense(np.array([len(hits)]), np.array([len(hits) / max(1, n)]), np.array([shape(text, n)]))[0]
        z += float(np.dot(dense, self.dense))
        return 1 / (1 + math.exp(-max(-500, min(500, self.scale * (z - self.cut) + math.log(CUT / (1 - CUT))))))


EMPTY = Model({}, (0.0,) * 6, -5.0, 1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows; without rows of both kinds the model scores all as clean.

    ``labels`` holds the rows to learn from only (id and label). Of several
    labels of an id the largest counts; null labels and ids are left out.
    """
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    given = given.orderBy(F.xxhash64(id_col), id_col).limit(sample)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(given), id_col).select("y", "text")
    rows = saved(rows, "toxicity-sample")
    sizes = {r["y"] > 0: r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        drop_saved(rows)
        return EMPTY

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def handed() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)], ["feature", "clean", "toxic"])

        for batch in slices(batches, "text"):
            for y, raw in zip(batch.column(0).to_pylist(), payloads(batch.column(1)), strict=True):
                counts[y > 0].update(features(words(raw.decode("utf-8", "replace"))))
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield handed()
                    for c in counts:
                        c.clear()
        yield handed()

    counts = rows.mapInArrow(counted, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    test = evidence(F.col("toxic"), F.col("clean"), sizes[True], sizes[False])
    chosen = counts.select("feature", test.alias("test")).where(F.col("test") >= CHANCE).orderBy(F.desc("test"), "feature").limit(LEXICON).collect()
    place = {bytes(r["feature"]): k for k, r in enumerate(sorted(chosen))}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for y, raw in zip(batch.column(0).to_pylist(), payloads(batch.column(1)), strict=True):
                text = raw.decode("utf-8", "replace")
                found = words(text)
                out.append((int(y > 0), sorted(place[f] for f in features(found) & place.keys()), len(found), list(shape(text, len(found)))))
            columns = zip(*out, strict=True) if out else [()] * 4
            types = [pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["y", "hits", "n", "shapes"])

    got = sorted(tuple(r) for r in rows.mapInArrow(marked, "y int, hits array<int>, n long, shapes array<double>").collect())  # sample x LEXICON at most
    drop_saved(rows)
    if not place:
        return EMPTY
    y, n, shapes = np.array([g[0] for g in got], np.float64), np.array([g[2] for g in got]), np.array([g[3] for g in got], np.float64)
    x = np.zeros((len(got), len(place)), np.float32)
    for i, g in enumerate(got):
        x[i, g[1]] = 1
    hits = x.sum(1)
    density = hits / np.maximum(1, n)
    votes = np.column_stack([np.where(x > 0, np.int8(1), np.int8(-1)), _pattern_votes(hits, density, shapes).astype(np.int8)])
    soft = LabelModel().fit(votes).posterior(votes)
    known = np.column_stack([x, _dense(hits, density, shapes).astype(np.float32)])
    w = _logistic(known, soft)
    z = known @ w[:-1] + w[-1]
    slope = float(_logistic(z[:, None], y, l2=1e-3)[0])  # Platt: how sure a margin is, by the sample's own labels
    lexicon = {f: float(w[k]) for f, k in place.items()}
    return Model(lexicon, tuple(w[len(place) : -1].tolist()), float(w[-1]), max(slope, 1e-3), best_cut(z, y))


def evidence(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Twice the log-likelihood ratio that toxic rows have a feature more often than others; 0 if not four times as often."""

    def part(k: Column, n: int) -> Column:
        inside = lambda r: F.least(F.greatest(r, F.lit(1e-12)), F.lit(1 - 1e-12))
        own, every = inside(k / n), inside((pos + neg) / (n_pos + n_neg))
        return k * F.log(own / every) + (n - k) * F.log((1 - own) / (1 - every))

    often = (pos + 0.5) / (n_pos + 1) >= 4 * (neg + 0.5) / (n_neg + 1)
    return F.when(often, F.round(2 * (part(pos, n_pos) + part(neg, n_neg)), 9)).otherwise(0.0)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The margin's cut with the best F1; half-way to the next margin below."""
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # ties go together
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep`` and ``score`` for every input row.

    Null texts are scored like empty ones; equal texts get equal scores;
    repeated rows are each scored; an empty table gives no row; underscores
    follow ``score`` where a kept column has that name.
    """
    kept = [id_col, *(c for c in keep if c != id_col)]
    named = "score"
    while named.lower() in {c.lower() for c in kept}:
        named += "_"
    plain = [f"c{i}" for i in range(len(kept))]  # the columns' own names may hold anything

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "scored"):
            scores = [model.score(x.decode("utf-8", "replace")) for x in payloads(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores, pa.float64())], [*plain, "score"])

    rows = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(kept, plain, strict=True)], F.col(f"`{text_col}`").cast("string").alias("scored"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(kept)]) + ", score double"
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(p).alias(c) for p, c in zip(plain, kept, strict=True)], F.col("score").alias(named))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on labels outside the held-out fold, score all rows: id, ``held_out``, ``score``, ``predicted``.

    Null and empty texts are scored as texts without words; equal texts get
    equal scores; repeated rows are each scored; a null id is outside the
    held-out fold or in it as the empty text's checksum says; an empty table
    gives no row; other columns are ignored. Texts of any length are read whole.
    """
    held = fold(1, 3, F.col(id_col))
    model = train(docs, labels.where(~fold(1, 3, F.col(id_col))), id_col, text_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
