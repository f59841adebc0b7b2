"""Operator 11: periodic runs of words, by an enhanced suffix array.

A run is a maximal stretch of words with smallest period q that is at least
``max(shortest, 2 * q)`` words long.  Its last ``2 * q`` words are a square
whose next word breaks the period, so the square's half is an LCP interval of
depth q in which the two occurrences lie in different children (a branching
tandem).  A batch of documents is worked on at once in numpy:

1. Words get numbers of their document, so no two documents share a word.  A
   run of 12 words repeats six words q places on, whatever q is, so stretches
   in which no six words recur in their document are replaced by one unique
   separator each; every run and its neighbours are left as they are.
2. Prefix doubling gives the suffix array, its inverse and the ranks of all
   stretches of a power of two words, with which common extensions of any
   two places are read in logarithmic time; LCP values are those of neighbours.
3. The children of LCP intervals are index ranges between LCP values (nearest
   smaller values by pointer jumping); there are no tree nodes.  Members i of
   all children but the largest look up ``ISA[i + depth]`` and
   ``ISA[i - depth]``: a place inside the interval but in another child is a
   square.
4. Squares are rotated left as long as the period holds and merged: of equal
   stretches the smallest period stays.

Work is row by row (n log n in the recurring words of a document); nothing is
shuffled and no group of rows ever meets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_runs, whole_text
from .words import mix

SHORTEST = 12
#: Members of interval children looked up at a time.
BLOCK = 1 << 21


def _stretch_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... symbols at every place, up to
    the length at which all differ; the last symbol must be unique."""
    n, step = len(symbols), 1
    small = np.int32 if n < 1 << 31 else np.int64
    levels = [symbols.astype(small)]
    while int(levels[-1].max()) + 1 < n:
        last = levels[-1]
        second = np.zeros(n, np.int64)
        second[:-step] = last[step:] + 1
        key = last.astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[False], np.diff(key[order]) != 0])
        rank = np.empty(n, small)
        rank[order] = np.cumsum(fresh)
        levels.append(rank)
        step *= 2
    return levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that agree from different places ``a`` and ``b`` on."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        same = (x < n) & (y < n)
        same &= levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
        out[same] += 1 << k
    return out


def _common_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that agree right before ``a`` and ``b`` (a < b)."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - out - (1 << k), b - out - (1 << k)
        same = (x >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])
        out[same] += 1 << k
    return out


def _jump(start: np.ndarray, go_on: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Follows pointers from every place while ``go_on(place, pointer)``; the
    pointers of places on the way may already be ahead."""
    at = start.copy()
    active = np.arange(1, len(at) - 1)
    while len(active):
        active = active[go_on(active, at[active])]
        at[active] = at[at[active]]
    return at


def _squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square whose next word breaks its period."""
    isa, n = levels[-1].astype(np.int64), len(levels[-1])
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = _common(levels, sa[:-1], sa[1:])
    places = np.arange(n + 1)
    before = _jump(np.maximum(places - 1, 0), lambda k, p: lcp[p] > lcp[k])            # last value <= this one
    after = _jump(np.minimum(places + 1, n), lambda k, p: lcp[p] > lcp[k])
    left = _jump(before, lambda k, p: lcp[p] == lcp[k])                                # last value < this one
    right = _jump(after, lambda k, p: lcp[p] == lcp[k])
    edge = np.flatnonzero(lcp[:n] > 0)                                                 # borders inside intervals
    first = edge[lcp[before[edge]] < lcp[edge]]
    low, high = np.concatenate([edge, left[first]]), np.concatenate([after[edge], first])
    border = np.concatenate([edge, first])
    size = high - low
    interval = np.unique(left[border] * np.int64(n + 1) + right[border], return_inverse=True)[1]
    order = np.lexsort((size, interval))
    small = order[:-1][interval[order[:-1]] == interval[order[1:]]]                    # all children but the largest
    found_at, found_period = [], []
    total = np.cumsum(size[small])
    cuts = np.searchsorted(total, np.arange(BLOCK, int(total[-1]) + BLOCK, BLOCK)) + 1 if len(small) else []
    begin = 0
    for end in cuts:
        mine = small[begin:end]
        begin = end
        if not len(mine):
            continue
        sizes = size[mine]
        of = np.repeat(np.arange(len(mine)), sizes)
        member = sa[np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[mine][of]]
        lo, hi, k = low[mine][of], high[mine][of], border[mine][of]
        depth, l, r = lcp[k], left[k], right[k]
        for sign in (1, -1):
            other = member + sign * depth
            there = (other >= 0) & (other < n)
            rank = isa[np.where(there, other, 0)]
            there &= (rank >= l) & (rank < r) & ((rank < lo) | (rank >= hi))
            found_at.append(np.minimum(member, other)[there])
            found_period.append(depth[there])
    if not found_at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_period)


def runs_of(symbols: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, end, period) of the runs of a sequence whose last symbol
    is unique; symbols are numbers from 0 without gaps."""
    levels = _stretch_ranks(symbols)
    at, period = _squares(levels)
    start, end = at - _common_before(levels, at, at + period), at + 2 * period
    long = end - start >= shortest
    rows = np.stack([start[long], end[long], period[long]], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(1)])]
    return rows


def batch_runs(docs: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """Runs of each document: rows (start, end, period) by start, then period."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(d) for d in docs], np.int64)
    total, gram = int(sizes.sum()), max(1, shortest // 2)
    none = [np.empty((0, 3), np.int64)] * len(docs)
    if total < shortest:
        return none
    word = np.fromiter((x for d in docs for x in map(number.__getitem__, d)), np.int64, total)
    doc = np.repeat(np.arange(len(docs)), sizes)
    begin = np.cumsum(sizes) - sizes
    # Words in stretches of ``gram`` words that recur in their document (equal hashes only add places).
    spread = mix(word.astype(np.uint64) + np.uint64(1))
    key = np.zeros(total - gram + 1, np.uint64)
    for k in range(gram):
        key = key * np.uint64(0x9E3779B97F4A7C15) + spread[k: k + len(key)]
    inside = np.flatnonzero(doc[gram - 1:] == doc[: len(key)])
    key = mix(key[inside] + doc[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = inside[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    if not len(again):
        return none
    mark = np.zeros(total + 1, np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + gram, -1)
    kept = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    # The kept words, with a unique separator after each stretch of them.
    stop = np.concatenate([(np.diff(kept) != 1) | (np.diff(doc[kept]) != 0), [True]])
    place = np.arange(len(kept)) + np.cumsum(stop) - stop
    names, numbers = np.unique(doc[kept] * np.int64(len(number)) + word[kept], return_inverse=True)
    symbols = np.zeros(len(kept) + int(stop.sum()), np.int64)
    symbols[place] = numbers
    symbols[place[stop] + 1] = len(names) + np.arange(int(stop.sum()))
    rows = runs_of(symbols, shortest)
    origin = np.zeros(len(symbols), np.int64)
    origin[place] = kept
    start = origin[rows[:, 0]]
    which = doc[start]
    start = start - begin[which]
    rows = np.stack([start, start + rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    rows, which = rows[(order := np.lexsort((rows[:, 2], rows[:, 0], which)))], which[order]
    cut = np.searchsorted(which, np.arange(len(docs) + 1))
    return [rows[a:b] for a, b in zip(cut[:-1], cut[1:])]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, runs[:, 0] + runs[:, 2], 1)
    np.add.at(mark, runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()]


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
           prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Runs of every document: id, ``n_words``, ``runs`` (start, length,
    period of each, by start, then period) and ``collapsed`` (the text
    without the repetitions, its words joined by one space).

    Words are what ASCII white space separates.  ``prepare(id, words)`` may
    change a document's words before runs are sought.  Null text counts as
    empty (no words, no runs, empty collapsed text); rows are worked on each
    on its own, so repeated rows and null ids keep a row each; an empty table
    gives an empty result; further columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.word_runs import batch_runs, collapse

        struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            texts, ids = b.column(1).cast(pa.binary()).to_pylist(), b.column(0)
            for lo, hi in text_runs(texts):
                words = [t.split() for t in texts[lo:hi]]          # bytes are split at ASCII white space only
                if prepare:
                    words = [prepare(i, w) for i, w in zip(ids.slice(lo, hi - lo).to_pylist(), words)]
                runs = batch_runs(words, shortest)
                n = np.cumsum([0, *map(len, runs)])
                flat = np.concatenate(runs)
                lists = pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], fields=list(struct)))
                left = [b" ".join(collapse(w, r)) for w, r in zip(words, runs)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([len(w) for w in words], pa.int64()), lists,
                                                  pa.array(left, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = map_batches(rows, run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
