"""SentencePiece encoding and decoding, with sampled segmentations.

``encode`` and ``decode`` are the library's. ``sample`` draws ``k`` distinct
segmentations of a text without replacement, by Gumbel top-k over the lattice
of all its segmentations: a perturbed A-star search. A lattice's path
probability is the product of its pieces' unigram probabilities; a merge
vocabulary has ranks in their place, so the piece of rank r gets Zipf's 1 / (r + 2),
normalised. A character without a piece is its UTF-8 bytes.

The search's nodes are sets of segmentations that share a beginning. The
backward pass gives every lattice position the total weight of what may
follow, so a node's exact weight is known, and the largest Gumbel-perturbed
log-probability inside it can be drawn before anything in it is expanded. The
best node is opened by walking one path down; the path keeps the node's value,
and at every step the untaken pieces become one closed node, whose value is a
Gumbel truncated at the path's. The best closed node of a text is opened next,
and so on, ``k`` times; the best that stays closed is the threshold kappa.
A segmentation's inclusion score is the probability 1 - exp(-exp(log p - kappa))
that its perturbed log-probability passes kappa.

No piece crosses a blank, so the lattice is built once for each distinct word
of a batch, as flat arrays; walks run side by side for all words. Every random
number is a hash of (row key, round, word number, step): results do not depend
on how rows are dealt.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import payloads, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
SEED = 20_240
BLANK = "▁"
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+$")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SLOT = np.uint64(42)
#: Fewer words than this are walked one by one: numpy's cost a step would be larger.
_FEW = 6


def load_model(path: str = MODEL) -> bytes:
    """The model file's bytes, to be sent to the tasks (its size is the vocabulary's)."""
    with open(path, "rb") as f:
        return f.read()


# -- random numbers -------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    """In (0, 1), from a key and a counter."""
    return ((_mix(key + np.uint64(1) * _MULT * np.asarray(count, np.uint64)) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def row_key(key: object, seed: int = SEED) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(key).encode("utf-8", "replace"), seed)


# -- lattice --------------------------------------------------------------


@dataclass
class Vocabulary:
    """Pieces as hashes of their code points, with log-probabilities."""

    hashes: np.ndarray  # sorted
    ids: np.ndarray
    logs: np.ndarray
    flags: np.ndarray  # by a hash's first bits: 1 if a piece may have it, 2 if a longer piece may begin so
    place: np.ndarray  # by a hash's first bits: the first piece with these
    texts: list[bytes]
    longest: int
    byte_log: float

    @staticmethod
    def of(model: bytes) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        logs, normal, texts = np.full(n, -np.inf), [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                texts.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                texts.append(b"")
            else:
                texts.append(piece.replace(BLANK, " ").encode())
                normal.append((i, piece, max(0.0, -sp.get_score(i))))
        total = math.log(sum(1 / (r + 2) for _, _, r in normal))
        keys, beginnings = [], set()
        for i, piece, rank in normal:
            if BLANK in piece.lstrip(BLANK):
                raise ValueError("a piece crosses a blank: words cannot be taken one by one")
            logs[i] = -math.log(rank + 2) - total
            h = 0
            for c in piece:
                beginnings.add(h * int(_SPREAD) % 2**64)
                h = (h * int(_MULT) + ord(c) + 1) % 2**64
            keys.append((h * int(_SPREAD) % 2**64, i))
        keys.sort()
        hashes = np.array([k for k, _ in keys], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        flags, place = np.zeros(1 << 22, np.uint8), np.zeros(1 << 22, np.int32)
        slot = (hashes >> _SLOT).astype(np.int64)
        flags[slot] = 1
        flags[(np.array(sorted(beginnings), np.uint64) >> _SLOT).astype(np.int64)] |= 2
        place[slot[::-1]] = np.arange(len(slot))[::-1]
        return Vocabulary(hashes, np.array([i for _, i in keys], np.int16 if n < 1 << 15 else np.int32), logs, flags, place, texts, max(len(p) for _, p, _ in normal), -math.log(n))


@dataclass
class Lattice:
    """All words' positions, and at each the edges (pieces) that begin there, in order of length."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray  # a position's first edge
    edges: np.ndarray  # how many it has
    upto: np.ndarray  # (positions, most edges): running sums of the edges' shares, 2 where there is none
    source: np.ndarray  # by edge
    length: np.ndarray
    piece: np.ndarray  # -1: the character's bytes
    log: np.ndarray  # the piece's own log-probability
    share: np.ndarray  # among all ways on from the position
    rest: np.ndarray  # the other edges' shares
    weight: np.ndarray  # per word: log of the total weight of its segmentations
    codes: np.ndarray


def build_lattice(words: list[str], vocab: Vocabulary) -> Lattice:
    """``words`` without their first blank, which each of them has."""
    longest = vocab.longest
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(lengths)
    begin = end - lengths
    size = int(end[-1]) if len(words) else 0
    codes = np.frombuffer((BLANK + BLANK.join(words) if words else "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(end, lengths) - np.arange(size)  # characters to the word's end
    piece = np.full((size, longest), -2, vocab.ids.dtype)
    at, h, ahead_of = np.arange(size), np.zeros(size, np.uint64), left
    for k in range(longest):
        if k:
            on = ahead_of > k
            at, h, ahead_of = at[on], h[on], ahead_of[on]
        if not len(at):
            break
        h = h * _MULT + codes[at + k] + np.uint64(1)
        spread = h * _SPREAD  # a short piece's hash has empty first bits
        slot = (spread >> _SLOT).view(np.int64)
        flag = vocab.flags[slot]
        maybe = np.flatnonzero(flag & 1)
        hashed, place = spread[maybe], vocab.place[slot[maybe]]
        while len(maybe):
            found = vocab.hashes[place]
            hit = found == hashed
            piece[at[maybe[hit]], k] = vocab.ids[place[hit]]
            on = (found < hashed) & (place < len(vocab.hashes) - 1)  # the next piece may share the slot
            maybe, hashed, place = maybe[on], hashed[on], place[on] + 1
        on = np.flatnonzero(flag & 2)
        at, h, ahead_of = at[on], h[on], ahead_of[on]
    lone = np.flatnonzero(piece[:, 0] == -2)
    piece[lone, 0] = -1
    # positions by their distance to the word's end: what follows a position comes before it
    order = np.argsort(left.astype(np.int16) if not size or left.max() < 1 << 15 else left, kind="stable")
    piece = piece[order].ravel()
    flat = np.flatnonzero(piece != -2)
    ids = piece[flat]
    rank, k = np.divmod(flat.astype(np.int32), longest)
    source = order[rank]
    own = vocab.logs[ids]
    raw = np.flatnonzero(ids < 0)
    own[raw] = _byte_count(codes[source[raw]]) * vocab.byte_log
    target = source + k + 1
    target[left[source] == k + 1] = size  # a word's end: nothing follows
    counts = np.bincount(rank, minlength=size)
    cuts = np.r_[0, np.cumsum(counts)]
    ahead, share = np.zeros(size + 1), np.empty(len(own))
    groups = np.searchsorted(left[order], np.arange(1, (int(left.max()) if size else 0) + 2))
    for low, high in zip(groups[:-1], groups[1:], strict=True):
        if high - low < _FEW:  # so have all that follow
            _ahead_one_by_one(int(low), order, cuts, own, target, ahead, share)
            break
        edges, starts = slice(cuts[low], cuts[high]), cuts[low:high] - cuts[low]
        ways = own[edges] + ahead[target[edges]]
        top = np.maximum.reduceat(ways, starts)
        ways = np.exp(ways - np.repeat(top, counts[low:high]))
        total = np.add.reduceat(ways, starts)
        ahead[order[low:high]] = top + np.log(total)
        share[edges] = ways / np.repeat(total, counts[low:high])
    sure = share > 0.999
    rest = 1 - share
    if len(share):
        rest[sure] = np.add.reduceat(np.where(sure, 0, share), cuts[:-1])[rank[sure]]
    slot = np.arange(len(share)) - cuts[rank]
    upto = np.full((size, int(counts.max()) if size else 1), 2, np.float32)
    running = np.cumsum(share)
    upto[source, slot] = running - (running - share)[cuts[rank]]
    first, edges = np.empty(size, np.int64), np.empty(size, np.int64)
    first[order], edges[order] = cuts[:-1], counts
    return Lattice(begin, end, first, edges, upto, source, k.astype(np.int64) + 1, ids, own, share, rest, ahead[begin], codes)


def _ahead_one_by_one(rank: int, order: np.ndarray, cuts: np.ndarray, own: np.ndarray, target: np.ndarray, ahead: np.ndarray, share: np.ndarray) -> None:
    """The backward pass from position ``rank`` of ``order`` on, in place, for the last letters of the longest words."""
    seen, exp = memoryview(ahead), math.exp
    for low in range(rank, len(order), 65_536):
        high = min(low + 65_536, len(order))
        first = int(cuts[low])
        bounds, logs, to = (cuts[low : high + 1] - first).tolist(), own[first : cuts[high]].tolist(), target[first : cuts[high]].tolist()
        shares: list[float] = []
        for place, a, b in zip(order[low:high].tolist(), bounds[:-1], bounds[1:], strict=True):
            ways = [logs[e] + seen[to[e]] for e in range(a, b)]
            top = max(ways)
            ways = [exp(w - top) for w in ways]
            total = sum(ways)
            seen[place] = top + math.log(total)
            shares += [w / total for w in ways]
        share[first : cuts[high]] = shares


def _byte_count(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def walk(lattice: Lattice, at: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw one way from each position ``at`` to ``end``: walk after walk, the walk's number and the edge."""
    n = len(at)
    here, active, out, t = at, np.arange(n), [], 0
    while True:
        going = here < end[active]
        here, active = here[going], active[going]
        if len(here) < _FEW:
            out += [_walk_alone(lattice, int(h), int(end[a]), key[a : a + 1], int(a), t) for h, a in zip(here, active, strict=True)]
            break
        u = _uniform(key[active], t).astype(np.float32)
        pick = (lattice.upto[here] <= u[:, None]).sum(1)
        edge = lattice.first[here] + np.minimum(pick, lattice.edges[here] - 1)
        out.append((active, edge))
        here = here + lattice.length[edge]
        t += 1
    counts = np.zeros(n, np.int64)
    for who, edge in out:
        counts[who] += 1 if isinstance(who, np.ndarray) else len(edge)
    first = np.cumsum(counts) - counts
    edges = np.empty(int(counts.sum()), np.int64)
    for t, (who, edge) in enumerate(out):
        if isinstance(who, np.ndarray):
            edges[first[who] + t] = edge
        else:  # one walk's last steps
            edges[first[who] + counts[who] - len(edge) : first[who] + counts[who]] = edge
    return np.repeat(np.arange(n), counts), edges


def _walk_alone(lattice: Lattice, here: int, end: int, key: np.ndarray, who: int, t: int) -> tuple[int, list[int]]:
    """The walk number and the edges from step ``t`` on of a single walk; the same choices as side by side."""
    out, draws, begin = [], [], t
    while here < end:
        if t - begin == len(draws):
            draws += _uniform(key, np.arange(t, t + min(4096, 16 + len(draws)))).astype(np.float32).tolist()
        u, most = draws[t - begin], int(lattice.edges[here])
        pick = 0
        for x in lattice.upto[here, :most].tolist():
            if x > u:
                break
            pick += 1
        edge = int(lattice.first[here]) + min(pick, most - 1)
        out.append(edge)
        here += int(lattice.length[edge])
        t += 1
    return who, out


# -- search ---------------------------------------------------------------


@dataclass
class Path:
    """One segmentation: its edges, the words they belong to, and its perturbed log-probability."""

    edges: np.ndarray
    word: np.ndarray
    value: float


def _truncated(logs: np.ndarray, most: float, u: np.ndarray) -> np.ndarray:
    """Gumbels located at ``logs``, given that they are at most ``most``."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(logs), -np.inf, logs - np.log(np.exp(np.minimum(logs - most, 700.0)) - np.log(u)))


def split(text: str) -> list[str]:
    """The words of a text, each without the one blank that goes before it; further blanks stay with the word they precede."""
    if not text:
        return []
    if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _WORDS.findall((BLANK + text).replace(" ", BLANK))]
    return text.split(" ")


def sample_texts(texts: list[str], keys: list[int], vocab: Vocabulary, k: int = K) -> list[list[tuple]]:
    """Per text up to ``k`` of (ids, log-probability, perturbed value, inclusion score), best value first."""
    place: defaultdict[str, int] = defaultdict(count().__next__)
    numbers = [np.fromiter(map(place.__getitem__, x), np.int64, len(x)) for x in map(split, texts)]
    lattice = build_lattice(list(place), vocab)
    key = np.array(keys, np.uint64)
    root = -np.log(-np.log(_uniform(key, 1)))
    paths: list[list[Path]] = [[] for _ in texts]
    closed: list[list] = [[] for _ in texts]  # heaps of (-value, path number, step, edges that are taken)
    with np.errstate(divide="ignore"):
        log_share, log_rest = np.log(lattice.share), np.log(lattice.rest)

    def open_nodes(todo: list[tuple]) -> None:
        """(text, value, path number or -1, step, taken edges): a new path each, that leaves the old one at ``step``."""
        turn = _mix((np.array([len(paths[d]) for d, *_ in todo], np.uint64) + np.uint64(2)) * _MULT)
        turn = _mix(key[[d for d, *_ in todo]] ^ turn)
        forced, starts, ends, words, walk_keys = [], [], [], [], []
        for i, (d, _, p, step, taken) in enumerate(todo):
            x, word = numbers[d], np.arange(len(numbers[d]))
            start = lattice.begin[x]
            if p >= 0:  # the first edge is drawn here, from those not taken yet
                old = paths[d][p]
                edge = int(old.edges[step])
                own = np.arange(lattice.first[lattice.source[edge]], lattice.first[lattice.source[edge]] + lattice.edges[lattice.source[edge]])
                shares = np.where(np.isin(own, taken), 0.0, lattice.share[own])
                sums = np.cumsum(shares)
                at = int(np.searchsorted(sums, _uniform(turn[i : i + 1], 1 << 40)[0] * sums[-1], side="right"))
                at = min(at, int(np.flatnonzero(shares)[-1]))
                forced.append((int(own[at]), shares[at], sums[-1]))
                word = word[old.word[step] :]
                start = start[old.word[step] :].copy()
                start[0] = lattice.source[own[at]] + lattice.length[own[at]]
            starts.append(start)
            ends.append(lattice.end[x[word]])
            words.append(word)
            walk_keys.append(_mix(turn[i : i + 1] + _MULT * word.astype(np.uint64)))
        start, end, wk, word = (np.concatenate(a) for a in (starts, ends, walk_keys, words))
        who, edges = walk(lattice, start, end, wk)
        step_log, aside = log_share[edges], log_rest[edges]
        word_of = word[who]
        cut = np.searchsorted(who, np.cumsum([0, *map(len, starts)]))
        for i, (d, value, p, step, taken) in enumerate(todo):
            span = slice(cut[i], cut[i + 1])
            mass, kept, new, new_word = 0.0, 0, edges[span], word_of[span]
            if p >= 0:
                old = paths[d][p]
                edge, share, total = forced[i]
                before = float(log_share[old.edges[:step]].sum())
                mass, kept = before + math.log(share), step + 1
                new = np.concatenate([old.edges[:step], [edge], new])
                new_word = np.concatenate([old.word[: step + 1], new_word])
                left = total - share
                if left > 1e-15 * total:
                    bound = _truncated(np.array([before + math.log(left)]), value, _uniform(turn[i : i + 1], 1 << 41))
                    heapq.heappush(closed[d], (-float(bound[0]), len(paths[d]), step, (*taken, edge)))
            logs = mass + np.cumsum(step_log[span]) - step_log[span] + aside[span]
            # a Gumbel here lies within -4 .. 37 of its location: steps far below the best k + 1 locations cannot win
            worth = np.arange(len(logs)) if len(logs) <= k + 1 else np.flatnonzero(logs >= np.partition(logs, -k - 1)[-k - 1] - 42)
            own = edges[span][worth]
            values = _truncated(logs[worth], value, _uniform(wk[who[span][worth]], lattice.source[own] - start[who[span][worth]] + (1 << 32)))
            for t in (np.argpartition(-values, k)[: k + 1] if len(values) > k + 1 else np.arange(len(values))).tolist():
                if values[t] > -np.inf:
                    heapq.heappush(closed[d], (-float(values[t]), len(paths[d]), kept + int(worth[t]), (int(own[t]),)))
            paths[d].append(Path(new, new_word, value))

    if texts:
        open_nodes([(d, float(root[d]), -1, 0, ()) for d in range(len(texts))])
    for _ in range(k - 1):
        todo = []
        for d, heap in enumerate(closed):
            if heap:
                value, *node = heapq.heappop(heap)
                todo.append((d, -value, *node))
        if todo:
            open_nodes(todo)
    out = []
    for d, found in enumerate(paths):
        kappa = -closed[d][0][0] if closed[d] else -math.inf
        weight = float(lattice.weight[numbers[d]].sum())
        rows = []
        for path in found:
            log_p = float(lattice.log[path.edges].sum()) - weight
            inclusion = -math.expm1(-math.exp(min(700.0, log_p - kappa))) if kappa > -math.inf else 1.0
            rows.append((_ids(lattice, path.edges), log_p, path.value, inclusion))
        out.append(rows)
    return out


def _ids(lattice: Lattice, edges: np.ndarray) -> np.ndarray:
    """Piece ids; characters without a piece become their bytes' ids."""
    ids = lattice.piece[edges]
    lone = np.flatnonzero(ids == -1)
    if not len(lone):
        return ids
    codes = lattice.codes[lattice.source[edges[lone]]]
    if (codes < 0x80).all():
        ids[lone] = codes.astype(np.int32) + 3
        return ids
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
    parts = np.split(ids, lone)
    return np.concatenate([parts[0], *(np.concatenate([np.frombuffer(r, np.uint8).astype(np.int32) + 3, p[1:]]) for r, p in zip(raw, parts[1:], strict=True))])


def joined(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """Decoding: the pieces' bytes without the first blank."""
    out = b"".join(map(vocab.texts.__getitem__, ids.tolist()))
    return out[1:] if out[:1] == b" " else out


# -- columns --------------------------------------------------------------


def _mapped(docs: DataFrame, id_col: str, col: str, work, schema: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(col).alias("value")).mapInArrow(work, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """``id_col`` and ``ids`` (array of int): the library's own segmentation; null and empty texts have no ids."""
    model = load_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in slices(batches, "value"):
            ids = sp.encode([x.decode("utf-8", "replace") for x in payloads(batch.column(1))], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return _mapped(docs, id_col, text_col, run, "ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """``id_col`` and ``text``; null ids decode to the empty text, ids outside the vocabulary and null ids inside a list are left out."""
    model = load_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        for batch in batches:
            texts = [sp.decode([i for i in x or () if i is not None and 0 <= i < size]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return _mapped(encoded, id_col, ids_col, run, "text string")


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, path: str = MODEL, seed: int = SEED, ids: bool = False) -> DataFrame:
    """Up to ``k`` rows per input row: ``id_col``, ``sample`` (1 is best), ``n_pieces``, ``log_prob``, ``perturbed``, ``inclusion``, ``ids_crc32``, ``round_trip``.

    The random numbers follow from the id, so equal rows get equal samples and
    other texts or partitions change nothing. Null and empty texts have one
    segmentation, the empty one; a text with fewer than ``k`` segmentations
    gives all it has. ``round_trip`` says that the ids decode to the text (a
    literal U+2581 decodes to a blank, as in the library). ``ids`` adds the ids.
    """
    model = load_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.of(model)
        for batch in slices(batches, "value", 3_000_000):
            texts = [x.decode("utf-8", "replace") for x in payloads(batch.column(1))]
            rows, owners = [], []
            for i, (text, found) in enumerate(zip(texts, sample_texts(texts, [row_key(x, seed) for x in batch.column(0).to_pylist()], vocab, k), strict=True)):
                want = text.replace(BLANK, " ").encode("utf-8", "surrogatepass")
                for n, (own, log_p, value, inclusion) in enumerate(found, 1):
                    row = (n, len(own), log_p, value, inclusion, zlib.crc32(own.astype("<i4").tobytes()), joined(own, vocab) == want)
                    rows.append((*row, own) if ids else row)
                    owners.append(i)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = ["id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_crc32", "round_trip", *["ids"] * ids]
    types = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())][: 7 + ids]
    schema = "sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * ids
    return _mapped(docs.withColumn(text_col, F.col(text_col).cast("string")), id_col, text_col, run, schema)
