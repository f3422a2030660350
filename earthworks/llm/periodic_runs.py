"""Periodic runs of words, by internal pattern matching.

A run is a stretch of words with smallest period q and at least ``times`` * q and ``least`` words that no neighbouring word
extends. Let B be the power of two with B/2 < q <= B. The run holds an aligned block of B words, and since a rotation of a
primitive word occurs in a run only at multiples of its period, the block's nearest occurrence to the left or the right
that lies in the run is q words away. So each aligned block asks for its occurrences in the windows beside it:

* prefix doubling gives the suffix array of the words and, on the way, the interval of it that each block of 1, 2, 4, ...
  words has;
* a wavelet tree over the suffix array answers range successor and predecessor: the next place in a block's interval after
  the block, and the last before it. Their distance is the difference of the progression that the occurrences form, a
  candidate period if it is in (B/2, B];
* a candidate is extended to both sides, by the ranks of the doubling steps, and kept if it is long enough.

Before that, places are left out that no run can hold: a place of a run of period q has an equal word within q places, so
one whose nearest equal word is over 1/``times`` of its stretch away is in none. What goes splits its stretch; what stays
goes through the search, the stretches of many texts at once. All steps inside a task are array operations on blocks of
whole texts of bounded size; a longer text is a block of its own, with some 100 bytes a word.

Defined results: null, empty and blank texts have no words, no runs, and collapse to an empty text. Repeated rows each get a
result. Runs are sorted by start, then period; of the strongest ones the first counts. Empty tables give empty results.
Only the keys and the text are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST, TIMES = 6, 4
BLOCK = 2 << 20
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
NONE = np.zeros((0, 3), np.int64)


class WaveletTree:
    """Numbers below 2**bits by their bits from the top; each level keeps how many ones come before a place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(values.max()).bit_length(), 1) if len(values) else 1
        self.ones: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]))
            values = np.concatenate([values[~one], values[one]])

    def upto(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers at the places [low, high) are at most ``value``, which is below 2**bits."""
        total = np.zeros(len(low), np.int64)
        for bit, ones in zip(range(self.bits - 1, -1, -1), self.ones, strict=True):
            a, b, zeros = ones[low], ones[high], len(ones) - 1 - ones[-1]
            right = (value >> bit & 1).astype(bool)
            total += np.where(right, (high - b) - (low - a), 0)
            low, high = np.where(right, zeros + a, low - a), np.where(right, zeros + b, high - b)
        return total + (high - low)

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest number, from 0, at the places [low, high)."""
        found = np.zeros(len(low), np.int64)
        for bit, ones in zip(range(self.bits - 1, -1, -1), self.ones, strict=True):
            a, b, zeros = ones[low], ones[high], len(ones) - 1 - ones[-1]
            fewer = (high - b) - (low - a)
            right = k >= fewer
            found += np.where(right, 1 << bit, 0)
            k = np.where(right, k - fewer, k)
            low, high = np.where(right, zeros + a, low - a), np.where(right, zeros + b, high - b)
        return found


def suffixes(words: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for blocks of 1, 2, 4, ... words where in it the suffixes with the block of a place begin.

    No two suffixes agree in over ``longest`` words. A step sorts only what the one before left equal.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    fresh = np.append(True, words[order[1:]] != words[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks, block = [rank.astype(np.int32)], 1
    while block <= longest:
        starts = np.flatnonzero(fresh)
        tied = np.flatnonzero(np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n))))
        if not tied.size:
            break
        places = order[tied]
        behind = places + block
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = rank[places] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[tied] = places
        new = np.append(True, key[1:] != key[:-1])
        fresh[tied] = new
        rank = rank.copy()
        rank[places] = np.maximum.accumulate(np.where(new, tied, 0))
        ranks.append(rank.astype(np.int32))
        block *= 2
    return order, ranks


def candidates(order: np.ndarray, ranks: list[np.ndarray], longest: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``a`` and distances ``d`` at which an aligned block occurs next to itself; d is a possible period."""
    tree, n, found = WaveletTree(order), len(order), []
    for level, rank in enumerate(ranks):
        block = 1 << level
        if block // 2 * times >= longest:
            break
        at = np.arange(0, n - block + 1, block)
        low = rank[at].astype(np.int64)
        # ranks along the suffix array rise, so the next larger one ends the interval
        high = np.searchsorted(rank[order], low, side="right")
        many = high - low > 1
        at, low, high = at[many], low[many], high[many]
        seen = tree.upto(low, high, at)
        for place, ok in ((seen, seen < high - low), (seen - 2, seen > 1)):
            other = tree.smallest(low[ok], high[ok], place[ok])
            first, gap = np.minimum(at[ok], other), np.abs(other - at[ok])
            near = (gap <= block) & (2 * gap > block)
            found.append((first[near], gap[near]))
    a, d = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, d


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words after (before) the places a and b agree; a < b."""
    total, n = np.zeros(len(a), np.int64), len(ranks[0])
    for level in range(len(ranks) - 1, -1, -1):
        block, rank = 1 << level, ranks[level]
        if back:
            ok = a >= block
            ok[ok] = rank[a[ok] - block] == rank[b[ok] - block]
        else:
            ok = b + block <= n
            ok[ok] = rank[a[ok]] == rank[b[ok]]
        step = np.where(ok, block, 0)
        total += step
        a, b = (a - step, b - step) if back else (a + step, b + step)
    return total


def runs_of(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period), sorted. No word sequence repeats over ``longest`` words."""
    order, ranks = suffixes(words, longest)
    a, d = candidates(order, ranks, longest, times)
    end = a + d + _common(ranks, a, a + d, back=False)
    start = a - _common(ranks, a, a + d, back=True)
    length = end - start
    good = length >= np.maximum(least, times * d)
    rows = np.unique(np.stack([start[good], d[good], length[good]], axis=1), axis=0)
    return rows[:, [0, 2, 1]]


def _stretches(ids: np.ndarray, text: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that can lie in a run, and where among them each stretch begins."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    one, two = order[:-1], order[1:]
    same = (ids[one] == ids[two]) & (text[one] == text[two])
    one, two = one[same], two[same]
    near = np.full(n, n, np.int64)
    near[one] = two - one
    near[two] = np.minimum(near[two], two - one)
    at = np.flatnonzero(near * times <= n)
    while True:
        line = at + text[at]  # places of different texts are never next to each other
        edges = np.flatnonzero(np.append(True, np.diff(line) != 1)) if at.size else np.zeros(0, np.int64)
        lengths = np.diff(np.append(edges, len(at)))
        of = np.repeat(lengths, lengths)
        stay = (of >= least) & (near[at] * times <= of)
        if stay.all():
            return at, edges
        at = at[stay]


def search(ids: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs of several texts, given by word numbers and the text of each word: rows (start, length, period), sorted."""
    at, edges = _stretches(ids, text, least, times)
    if not at.size:
        return NONE
    lengths = np.diff(np.append(edges, len(at)))
    # equal words of different stretches differ, and a word of its own ends each stretch
    stretch = np.repeat(np.arange(len(edges)), lengths)
    _, own = np.unique(stretch * (int(ids.max()) + 1) + ids[at], return_inverse=True)
    marks = np.arange(len(edges)) + len(at)
    words = np.insert(own, edges[1:], marks[:-1])
    runs = runs_of(np.append(words, marks[-1]), int(lengths.max()), least, times)
    begin = np.insert(at, edges[1:], -1)
    runs[:, 0] = begin[runs[:, 0]]
    return runs


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the text of each. Arrow's ASCII white space is that of the words here."""
    lists = pc.ascii_split_whitespace(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    return pc.filter(flat, some), pc.filter(parent, some).to_numpy()


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def _solved(texts: pa.Array, least: int, times: int) -> list[pa.Array]:
    """Runs and collapsed text of each text."""
    flat, text = _words(texts)
    ids = flat.dictionary_encode().indices.to_numpy()
    runs = search(ids, text, least, times) if len(ids) else NONE
    counts = np.bincount(text, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    of = text[runs[:, 0]]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(change[:-1]) == 0
    left = pa.LargeListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(np.bincount(text[stay], minlength=len(texts)))), pa.int64()),
        flat if stay.all() else flat.filter(pa.array(stay)))
    joined = pc.binary_join(left, pa.scalar(" ", pa.large_string()))
    shown = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - begin[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=RUN.names)
    return [_lists(np.bincount(of, minlength=len(texts)), shown), pc.cast(joined, pa.string())]


def found(df: DataFrame, keys: list[str], text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The keys, ``runs`` (an array of start, length and period) and ``collapsed`` of every row.

    The collapsed text has the words, joined by spaces, that no run holds after its first period.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(pc.fill_null(batch.column(len(keys)), "")).to_numpy())
            edges = np.append(np.flatnonzero(np.diff(size // BLOCK, prepend=-1)), len(size))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[: len(keys)], *_solved(rows.column(len(keys)), least, times)], names=schema.names)

    return df.select(*[F.col(f"`{k}`") for k in (*keys, text)]).mapInArrow(solve, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones, null without runs."""
    none = F.lit(None).cast(RUN)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
