"""Language-model scores: a hidden Markov model trained by Baum-Welch over the corpus.

Tokens are words between ASCII white space with A-Z lowered, and one end mark
a text. The ``SYMBOLS`` most frequent words are emission symbols of their own;
every other word, known or not, is emitted through one of ``CLASSES`` classes
of like endings: P(word | state) = P(class | state) * P(word | class), where
P(word | class) = (c + 1) / (tokens + types + 1 of the class) keeps one share
for words never seen. The likelihood of a text is then a forward recursion
over symbols, times an order-free product over class words.

Training counts words over all training rows, writes each text once as an
array of symbols, and runs ``ROUNDS`` of Baum-Welch over whole texts, many
texts side by side: each task sums its expected counts, a grouped sum joins the
tasks', and the driver receives one number per model parameter. Scoring runs
the scaled forward recursion over whole texts in the same way.

The ``HEAD`` most frequent words are sent to the tasks with their counts
(bounded, whatever the corpus); rarer words meet their counts in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import payloads, saved, slices

STATES = 6
SYMBOLS = 2_048
CLASSES = 128
HEAD = 262_144
ROUNDS = 3
#: Symbols whose forward states a training task keeps at once.
STEPS_HELD = 1_000_000
#: Symbols that are trained on side by side; texts of like length are taken together.
TOGETHER = 600_000
#: Distinct words that a counting task holds before it hands its counts on.
HELD = 400_000


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def class_column(word: Column) -> Column:
    """The same in the JVM, on a binary column."""
    return (F.crc32(F.when(F.octet_length(word) > 3, F.substring(word, -3, 3)).otherwise(word)) % CLASSES).cast("int")


# -- model ----------------------------------------------------------------


@dataclass
class HMM:
    start: np.ndarray  # (S,)
    step: np.ndarray  # (S, S)
    emit: np.ndarray  # (K, S): emit[k, s] = P(symbol k | state s)

    @staticmethod
    def first(counts: np.ndarray, states: int = STATES, seed: int = 11) -> HMM:
        """Frequencies, tilted differently in each state; states tend to stay."""
        noise = np.random.default_rng(seed).uniform(0.2, 1.8, (len(counts), states))
        emit = (counts + 0.1)[:, None] * noise
        step = np.full((states, states), 0.4 / states) + np.eye(states) * 0.6
        return HMM(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def of_counts(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> HMM:
        """Expected counts to probabilities; a small constant keeps every one above 0."""
        start, step, emit = start + 0.01, step + 0.01, emit + 0.01
        return HMM(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _time_major(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of step 0 of all sequences, then step 1, ...; how many are active in each step; the order used.

    Sequences are taken longest first, so those active in a step are the first.
    """
    lengths = np.array([len(p) for p in parts])
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    active = np.searchsorted(-ordered, -np.arange(ordered[0]), side="left") if len(parts) else np.zeros(0, np.int64)
    at = np.r_[0, np.cumsum(active)]
    flat = np.empty(int(ordered.sum()), parts[0].dtype)
    for rank, k in enumerate(order):
        flat[at[: ordered[rank]] + rank] = parts[k]
    return flat, active, order


def log_likelihoods(model: HMM, parts: list[np.ndarray]) -> np.ndarray:
    """Natural log of P(symbols) for each sequence, by the scaled forward recursion."""
    out = np.zeros(len(parts))
    if not len(parts):
        return out
    flat, active, order = _time_major(parts)
    total, at = np.zeros(len(parts)), 0
    state = None
    for n in active.tolist():
        seen = model.emit[flat[at : at + n]]
        at += n
        state = model.start * seen if state is None else (state[:n] @ model.step) * seen
        scale = state.sum(1)
        state /= scale[:, None]
        total[:n] += np.log(scale)
    out[order] = total
    return out


def expected_counts(model: HMM, parts: list[np.ndarray], held: int = STEPS_HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch over whole texts: expected start, step and emission counts and the log-likelihood.

    The forward states of about ``held`` symbols are kept at once. A first pass
    notes the states where each such block begins; blocks are then taken from
    the last to the first, their states worked out again and met by the
    backward recursion, which is carried from block to block. The counts are
    those of one uncut pass.
    """
    states, (flat, active, order) = len(model.start), _time_major(parts)
    at = np.r_[0, np.cumsum(active)]
    cuts = [0]
    while cuts[-1] < len(active):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + held, side="right")) - 1))

    def moved(state: np.ndarray | None, t: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = model.start * seen if state is None else (state[: active[t]] @ model.step) * seen
        scale = state.sum(1)
        state /= scale[:, None]
        return state, scale

    borders: list[np.ndarray | None] = [None]
    state = None
    for t in range(cuts[-2] if len(cuts) > 2 else 0):
        state, _ = moved(state, t, model.emit[flat[at[t] : at[t + 1]]])
        if t + 1 == cuts[len(borders)]:
            borders.append(state)
    start, steps, emit, total, later = np.zeros(states), np.zeros((states, states)), np.zeros((len(model.emit), states)), 0.0, None
    for k in range(len(cuts) - 2, -1, -1):
        low, high, state = at[cuts[k]], at[cuts[k + 1]], borders[k]
        forward, scales, seen = np.empty((high - low, states)), np.empty(high - low), model.emit[flat[low:high]]
        for t in range(cuts[k], cuts[k + 1]):
            here = slice(at[t] - low, at[t + 1] - low)
            forward[here], scales[here] = moved(state, t, seen[here])
            state = forward[here]
        for t in range(cuts[k + 1] - 1, cuts[k] - 1, -1):
            here = slice(at[t] - low, at[t + 1] - low)
            back = np.ones((active[t], states))
            if later is not None:
                back[: len(later)] = later @ model.step.T
                steps += forward[here][: len(later)].T @ later
            later = seen[here] * back / scales[here][:, None]
            forward[here] *= back  # now the posterior of the states
        emit += np.stack([np.bincount(flat[low:high], forward[:, s], len(model.emit)) for s in range(states)], 1)
        total += float(np.log(scales).sum())
        if not k:
            start = forward[: active[0]].sum(0)
    return start, steps * model.step, emit, total


# -- corpus counts --------------------------------------------------------


def word_counts(docs: DataFrame, text_col: str = "text", held: int = HELD) -> DataFrame:
    """(``word`` binary, ``n``) over all rows, each task's counts added up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text"):
            for text in payloads(batch.column(0)):
                counts.update(tokens(text))
                if len(counts) > held:
                    yield handed()
                    counts.clear()
        yield handed()

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` of the most frequent words, by falling count.

    A histogram over 32 steps an octave (some thousand rows at any size) gives
    the count from which words are few enough; only those reach the driver.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 32)
    low, found = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        found += r["count"]
        if found > most:
            break
        low = r["step"]
    if low is None:
        return []
    words = [(bytes(r[0]), r[1]) for r in counts.where(step >= low).select("word", "n").collect()]
    return sorted(words, key=lambda x: (-x[1], x[0]))


def _fit(symbols: DataFrame, counts: np.ndarray, rounds: int) -> HMM:
    """``symbols``: the training rows' ``syms`` (binary of uint16)."""
    model = HMM.first(counts)
    states, size = STATES, len(counts)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: HMM = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(states + states * states + size * states)
            for batch in slices(batches, "syms", 8_000_000):
                parts = sorted((np.frombuffer(raw, np.uint16) for raw in batch.column(0).to_pylist()), key=len)
                group = np.cumsum([len(x) for x in parts]) // TOGETHER
                for g in np.unique(group).tolist():
                    start, steps, emit, _ = expected_counts(model, parts[np.searchsorted(group, g) : np.searchsorted(group, g, side="right")])
                    total += np.concatenate([start, steps.ravel(), emit.ravel()])
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["k", "v"])

        got = symbols.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros(states + states * states + size * states)
        total[got["k"].to_numpy()] = got["v"].to_numpy()
        start, steps, emit = np.split(total, [states, states + states * states])
        model = HMM.of_counts(start, steps.reshape(states, states), emit.reshape(size, states))
    return model


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """One row per input row: id, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from the rows where ``train`` holds and scores all. ``base_score``
    is the add-one unigram score, ``score`` the model's log10 probability of
    the text. A null text is empty: one end mark. Equal texts get equal scores
    up to rounding; repeated rows count as often as they occur; with no
    training row every token is unknown; an empty table gives no row; other
    columns are ignored. Texts of any length are trained on and scored whole;
    a task holds some 2 bytes a token besides the forward states of a block.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), train.alias("train"), F.col(text_col).cast("string").alias("text"))
    counts = saved(word_counts(rows.where("train"), "text"), "lm-counts")
    learned = rows.where("train").count()
    classed = counts.select("word", "n", class_column(F.col("word")).alias("class"))
    top = frequent(counts, head)
    size = SYMBOLS + CLASSES + 1
    end = SYMBOLS + CLASSES
    freq = np.zeros(size)
    class_tokens, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    distinct = all_words = 0
    for r in classed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        class_tokens[r["class"]], class_types[r["class"]] = r["n"], r["types"]
        distinct, all_words = distinct + r["types"], all_words + r["n"]
    for k, (word, n) in enumerate(top[:SYMBOLS]):
        freq[k] = n
        class_tokens[word_class(word)] -= n
        class_types[word_class(word)] -= 1
    freq[SYMBOLS:end], freq[end] = class_tokens, learned
    shares = np.log10(class_tokens + class_types + 1)
    n_all, v_all = all_words + learned, distinct + (learned > 0)
    sent = docs.sparkSession.sparkContext.broadcast({w: (k, n) for k, (w, n) in enumerate(top)})
    whole = len(top) == distinct  # then every known word is at hand

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        log = [math.log10(n + 1) for n in range(65_536)]
        for batch in slices(batches, "text", 8_000_000):
            out = []
            for text in payloads(batch.column(3)):
                words = tokens(text)
                symbols = np.empty(len(words) + 1, np.uint16)
                symbols[-1] = end
                bag = Counter(words)
                base, inside, seen, rest, place = math.log10(learned + 1), 0.0, int(learned > 0), [], {}
                for word, n in bag.items():
                    at = known.get(word)
                    if at is None:
                        place[word] = SYMBOLS + word_class(word)
                        if whole:
                            inside -= n * shares[place[word] - SYMBOLS]
                        else:
                            rest.append({"word": word, "n": n})
                        continue
                    k, c = at
                    own = log[c] if c < 65_536 else math.log10(c + 1)
                    base += n * own
                    seen += n
                    if k < SYMBOLS:
                        place[word] = k
                    else:
                        place[word] = SYMBOLS + word_class(word)
                        inside += n * (own - shares[place[word] - SYMBOLS])
                symbols[:-1] = [place[w] for w in words]
                out.append((len(words) + 1, seen, base, inside, rest, symbols.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = ["row", "id", "train", "n_tokens", "seen", "base", "inside", "rest", "syms"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])), pa.binary()]
    schema = f"row long, id {kind}, train boolean, n_tokens long, seen long, base double, inside double, rest array<struct<word:binary,n:bigint>>, syms binary"
    encoded = saved(rows.select(F.monotonically_increasing_id().alias("row"), "id", "train", "text").mapInArrow(encode, schema), "lm-symbols")
    model = _fit(encoded.where("train").select("syms"), freq, rounds)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "syms", 4_000_000):
            found = log_likelihoods(model, [np.frombuffer(x, np.uint16) for x in batch.column(7).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(found / math.log(10))], [*plain, "chain"])

    plain = ["row", "id", "train", "n_tokens", "seen", "base", "inside"]
    chained = encoded.select(*plain, "syms").mapInArrow(forward, f"row long, id {kind}, train boolean, n_tokens long, seen long, base double, inside double, chain double")
    rare = encoded.where(F.size("rest") > 0).select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.n")
    share = F.element_at(F.array(*[F.lit(float(x)) for x in shares]), class_column(F.col("word")) + 1)
    found = rare.join(counts.withColumnRenamed("n", "c"), "word", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"), share.alias("share"))
    own = F.log10(F.col("c") + 1)
    tail = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_seen"), F.sum(F.col("n") * own).alias("tail_base"), F.sum(F.col("n") * (own - F.col("share"))).alias("tail_inside"))
    out = chained.join(tail, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "train", "n_tokens", (F.col("seen") + zero("tail_seen")).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base") - F.col("n_tokens") * math.log10(n_all + v_all + 1)).alias("base_score"), (F.col("chain") + F.col("inside") + zero("tail_inside")).alias("score"),
    )
