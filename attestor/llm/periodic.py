"""Periodic runs of words, found by recompression of whole texts.

1. The words of a block of documents become numbers; a mark that occurs once stands before, between and behind them.
2. Recompression: block compression replaces each maximal repetition of one letter by a new letter, pair compression splits
   the letters into left and right ones and replaces each left-right pair; both alternate until each document is one
   letter. Equal pieces get equal names wherever they stand, so the levels are a run-length grammar of all documents.
3. The longest common extension of two places climbs the levels as long as both places can be brought to the start of
   a letter with equal words passed, then comes down to the first words that differ: O(1) steps a level. Many pairs of
   places are extended at once, in both directions. No suffix array is built.
4. Candidates: a run of period q has at least max(12 - q, q) places whose word equals the one q later. So for periods in
   [Q, 2 Q) a grid of a step just under that many places, with WIDTH words compared by hash at each, meets every run: n / Q
   places for Q periods, n log n in all. Extending a candidate in both directions gives its stretch exactly.
5. A stretch of at least 2 q words with period q that has a smaller period has one that divides q and the same ends, so
   the smallest q of each (start, end) is the run's period.

Defined results: a null or blank text has no words, no runs, four nulls and the digests of empty strings; a null
doc_id has no periodic part put in; texts of any length are read whole; each row is judged for itself, repeated ones
too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import map_arrow, record_batch

#: Least length of a run in words.
LEAST = 12
#: Words compared by hash at a grid place; at most half of LEAST.
WIDTH = 4
#: Words that are compressed together, unless one document has more, and grid comparisons made at once.
BLOCK_WORDS, BLOCK_CELLS = 120_000, 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Level:
    """A sequence, and which of its letters make up each letter of the next one."""

    letters: np.ndarray
    parent: np.ndarray  # of each letter, its place in the next level
    first: np.ndarray  # of each letter of the next level, the place of its first one here; and the end
    blocks: bool  # block compression, else pair compression


def _names(keys: np.ndarray, free: int) -> tuple[np.ndarray, int]:
    """A new letter for each distinct key."""
    known, places = np.unique(keys, return_inverse=True)
    return (places + free).astype(np.int32), free + len(known)


class Grammar:
    """The levels of a sequence. Letters below 0 are marks, which occur once each and are never joined with others."""

    def __init__(self, letters: np.ndarray, free: int):
        self.levels: list[Level] = []
        letters, marks = letters.astype(np.int32), int((letters < 0).sum())
        joined = 0
        while len(letters) > 2 * marks - 1:
            same = letters[1:] == letters[:-1]
            if same.any():
                starts = np.flatnonzero(np.concatenate(([True], ~same)))
                lengths = np.diff(np.append(starts, len(letters)))
                after = letters[starts]
                long = lengths > 1
                after[long], free = _names(after[long].astype(np.int64) << 32 | lengths[long], free)
                letters = self._add(letters, starts, after, True)
                if len(letters) == 2 * marks - 1:
                    break
            joined += 1
            pairs = self._pairs(letters, joined)
            starts = np.flatnonzero(np.concatenate(([True], ~pairs)))
            after = letters[starts]
            begins = np.append(pairs, False)[starts]
            at = starts[begins]
            after[begins], free = _names(letters[at].astype(np.int64) << 32 | letters[at + 1], free)
            letters = self._add(letters, starts, after, False)
        self.top = letters

    def _add(self, letters: np.ndarray, starts: np.ndarray, after: np.ndarray, blocks: bool) -> np.ndarray:
        sizes = np.diff(np.append(starts, len(letters)))
        parent = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        self.levels.append(Level(letters, parent, np.append(starts, len(letters)).astype(np.int32), blocks))
        return after

    @staticmethod
    def _pairs(letters: np.ndarray, joined: int) -> np.ndarray:
        """Whether each place but the last begins a pair. Neighbours differ, so a split of the letters by a hash cuts a quarter of the
        pairs or more in one of the two directions; where it cuts none, the next one is tried."""
        for salt in range(joined * 64, joined * 64 + 64):
            mixed = (letters.astype(np.uint64) + np.uint64(salt)) * _ODD[0]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[1]
            left = (mixed >> np.uint64(63)).astype(bool)
            words = letters >= 0
            one, other = left & words, ~left & words
            ahead, back = one[:-1] & other[1:], other[:-1] & one[1:]
            best = ahead if ahead.sum() >= back.sum() else back
            if best.any():
                return best
        raise RuntimeError("no split of the letters joins any pair")

    def extend(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of different places of one document: how many words are equal from both on, and before both."""
        return self._extend(i, j, 1), self._extend(i, j, -1)

    @staticmethod
    def _passed(level: Level, x: np.ndarray, y: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters that can be passed at (x, y) in one step, and whether both then stand at the start of a letter of the next level."""
        back = 0 if way > 0 else 1
        same = level.letters[x - back] == level.letters[y - back]
        if not level.blocks:
            return same.astype(np.int64), same
        of_x, of_y = level.parent[x - back], level.parent[y - back]
        left_x = level.first[of_x + 1] - x if way > 0 else x - level.first[of_x]
        left_y = level.first[of_y + 1] - y if way > 0 else y - level.first[of_y]
        return np.where(same, np.minimum(left_x, left_y), 0).astype(np.int64), same & (left_x == left_y)

    def _extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        a, b = i.astype(np.int64), j.astype(np.int64)
        stopped = np.full(len(a), len(self.levels), np.int64)  # the level whose next letters differ
        open_ = np.arange(len(a))
        for h, level in enumerate(self.levels):
            if not len(open_):
                break
            x, y = a[open_], b[open_]
            inside = (level.first[level.parent[x]] != x) | (level.first[level.parent[y]] != y)
            if inside.any():
                at = open_[inside]
                steps, level_with = self._passed(level, a[at], b[at], way)
                a[at] += way * steps
                b[at] += way * steps
                stopped[at[~level_with]] = h
                inside[inside] = ~level_with
                open_ = open_[~inside]
            a[open_], b[open_] = level.parent[a[open_]], level.parent[b[open_]]
        order = np.argsort(-stopped, kind="stable")
        ends = np.searchsorted(-stopped[order], -np.arange(len(self.levels)), side="left")  # how many stopped above each level
        for h in range(len(self.levels) - 1, -1, -1):
            at = order[: ends[h]]
            if not len(at):
                continue
            level = self.levels[h]
            x, y = level.first[a[at]].astype(np.int64), level.first[b[at]].astype(np.int64)
            steps, _ = self._passed(level, x, y, way)
            a[at], b[at] = x + way * steps, y + way * steps
        return (a - i) * way


def _hashes(letters: np.ndarray) -> np.ndarray:
    """A hash of the WIDTH letters from each place on; equal letters give equal hashes."""
    n = len(letters) - WIDTH + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(WIDTH if n > 0 else 0):
        out = (out ^ letters[k : k + n].astype(np.uint64)) * _ODD[0]
        out ^= out >> np.uint64(31)
    return (out >> np.uint64(16)).astype(np.uint32)


def candidates(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) pairs of which every run of a document has one at least. Documents stand in order of falling size."""
    if not len(hashes):
        return
    low = 1
    while 2 * low <= sizes[0] and LEAST <= sizes[0]:
        least = min(max(LEAST - q, q) for q in (range(low, 2 * low) if low < LEAST else (low,)))
        step = least - WIDTH + 1
        held = int((sizes >= max(2 * low, LEAST)).sum())
        end = int(starts[held - 1] + sizes[held - 1])
        # the hashes q places later, for each q of the block, seen as a row for each grid place
        tail = np.concatenate((hashes[:end], np.full(2 * low + 1, hashes[-1], np.uint32)))
        places = np.arange(0, min(end, len(hashes)), step)
        rows = max(1, BLOCK_CELLS // low)
        for k in range(0, len(places), rows):
            some = places[k : k + rows]
            later = np.lib.stride_tricks.as_strided(tail[some[0] + low :], (len(some), low), (step * tail.itemsize, tail.itemsize), writeable=False)
            row, q = np.nonzero(later == hashes[some][:, None])
            place, period = some[row], q + low
            inside = place + period < end
            place, period = place[inside], period[inside]
            if len(place):
                of = np.searchsorted(starts, place, "right") - 1
                inside = (of >= 0) & (place + period < starts[of] + sizes[of])
                yield place[inside], period[inside]
        low *= 2


def runs(texts: list[np.ndarray], free: int) -> list[np.ndarray]:
    """The runs of each sequence of words (numbers from 0 to free - 1): rows (start, length, period) by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST]
    none = np.empty((0, 3), np.int64)
    if not len(order):
        return [none] * len(texts)
    own = sizes[order]
    starts = np.cumsum(own + 1) - own
    letters = np.full(int((own + 1).sum()) + 1, -1, np.int64)
    letters[np.concatenate(([0], starts + own))] = -1 - np.arange(len(own) + 1)
    for at, k in zip(starts.tolist(), order.tolist(), strict=True):
        letters[at : at + len(texts[k])] = texts[k]
    grammar, found = None, []
    for place, period in candidates(_hashes(letters), starts, own):
        grammar = grammar or Grammar(letters, free)
        ahead, back = grammar.extend(place, place + period)
        enough = ahead + back >= np.maximum(LEAST - period, period)
        rows = np.stack((place - back, ahead + back + period, period), 1)[enough]
        found.append(np.unique(rows, axis=0))
    if not found:
        return [none] * len(texts)
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    of = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows[:, 0] -= starts[of]
    out = [none] * len(texts)
    ends = np.searchsorted(of, np.arange(len(order) + 1))
    for k, at in enumerate(order.tolist()):
        out[at] = rows[ends[k] : ends[k + 1]]
    return out


def with_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, with a periodic part put into those of a tenth of the documents."""
    if doc_id is None or not words:
        return words
    hashed = zlib.crc32(str(doc_id).encode())
    if hashed % 10:
        return words
    g, n = hashed // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def longest(found: np.ndarray) -> tuple[int | None, int | None, int | None]:
    """start, length and period of the longest run; ties: smallest start, then period."""
    if not len(found):
        return None, None, None
    return tuple(found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist())


_COLUMNS = (("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()))


def _judged(ids: list[int | None], texts: list[list[bytes]]) -> Iterator[tuple]:
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    coded = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]
    for doc_id, words, found in zip(ids, texts, runs(coded, len(number)), strict=True):
        start, length, period = longest(found)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
        kept = b" ".join(collapsed(words, found))
        milli = 1000 * length // period if period else None
        yield doc_id, len(found), start, length, period, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = True) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256 and
    n_words of each row. planted: with_period is applied first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, words = [], [], 0

            def flush():
                rows = list(zip(*_judged(ids, texts), strict=True))
                return record_batch(**{name: pa.array(c, kind) for (name, kind), c in zip(_COLUMNS, rows, strict=True)})

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = (text.as_py() or b"").split()
                ids.append(doc_id)
                texts.append(with_period(own, doc_id) if planted else own)
                words += len(own)
                if words >= BLOCK_WORDS:
                    yield flush()
                    ids, texts, words = [], [], 0
            if ids:
                yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kinds = {pa.int64(): "long", pa.string(): "string"}
    return map_arrow(rows, run, ", ".join(f"{name} {kinds[kind]}" for name, kind in _COLUMNS))
