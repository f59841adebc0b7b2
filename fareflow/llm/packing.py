"""Operator 1: best-fit decreasing packing of token pieces into sequences.

Pieces of one length are interchangeable, so best-fit decreasing over the
whole corpus is a function of the histogram of piece lengths alone, which has
at most ``capacity`` rows at any corpus size:

1. Tasks tokenize the documents, cut them into pieces and number the pieces of
   each length within their partition (one pass, kept as a table).
2. The histogram is summed.  ``plan_bins`` runs best-fit decreasing on it: a
   segment tree over remaining capacities finds the tightest open bins in
   logarithmic time, and all bins of equal capacity are filled together.  The
   result is a list of runs "pieces a..b of length L go to bins c.. from
   offset o, k per bin"; its size depends on ``capacity`` only.
3. Each piece's number among all pieces of its length (a prefix sum over
   partitions) finds its run, and so its sequence and offset.

A length that a third of all pieces share is numbered by partition counts, so
no task gathers the pieces of a length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, map_batches, scratch_table, whole_text
from .word_bpe import words

CAPACITY = 2048
#: Distinct words kept per process.
CACHE_WORDS = 150_000


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the
    smallest capacity of at least a given size that has bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity).bit_length()
        self.held = [False] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, room: int, held: bool) -> None:
        i = self.leaves + room
        self.held[i] = held
        while i > 1:
            i //= 2
            self.held[i] = self.held[2 * i] or self.held[2 * i + 1]

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.runs.setdefault(room, []).append((first, n))
            if not self.held[self.leaves + room]:
                self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, False)
        return run

    def tightest(self, size: int) -> int | None:
        """Smallest remaining capacity >= ``size`` among open bins."""
        i = self.leaves + size
        if self.held[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.held[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.held[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over ``counts`` (length -> pieces).

    Rows (length, first piece, pieces, first bin, pieces per bin, offset),
    sorted by length and first piece.  Equal to placing piece by piece: once
    a piece is in the tightest bin, that bin stays the tightest for the next
    piece of the same length as long as it fits.
    """
    bins, rows, opened = OpenBins(capacity), [], 0
    for size in sorted(counts, reverse=True):
        done, n = 0, counts[size]
        while done < n:
            room = bins.tightest(size)
            if room is None:
                room, first = capacity, opened
                have = -(-(n - done) // (capacity // size))
                opened += have
            else:
                first, have = bins.take(room)
            each = room // size
            full = min(have, (n - done) // each)
            if full:
                rows.append((size, done, full * each, first, each, capacity - room))
                bins.put(room - each * size, first, full)
                done += full * each
            if full < have:
                rest = n - done if n - done < each else 0
                if rest:
                    rows.append((size, done, rest, first + full, rest, capacity - room))
                    bins.put(room - rest * size, first + full, 1)
                    done += rest
                bins.put(room, first + full + bool(rest), have - full - bool(rest))
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


class _WordIds:
    """Packed ids of texts by the tokenizers library, one call per distinct word or chunk."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids_of = Recent(self._encode, CACHE_WORDS)

    def _encode(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids_of.__getitem__, words(text)))


_ENCODERS: dict[str, _WordIds] = {}


def encoder(path: str) -> _WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = _WordIds(path)
    return _ENCODERS[path]


PIECES = ("id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def cut_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
               capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ids of the text, then id 0, cut every
    ``capacity`` tokens; ``part`` and ``nth`` number pieces of a length within
    a partition."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from fareflow.llm.packing import encoder

        enc, part, seen, step = encoder(path), TaskContext.get().partitionId(), {}, 4 * capacity
        for b in batches:
            rows, which, held = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = enc.encode(t) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at: at + step]
                    n = len(cut) // 4
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    which.append(i)
                    rows.append((k, at // 4, n, zlib.crc32(cut), nth))
                    if with_ids:
                        held.append(np.frombuffer(cut, "<u4").astype("i4"))
            cols = list(zip(*rows)) or [[]] * 5
            out = [b.column(0).take(pa.array(which, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                   pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array([part] * len(rows), pa.int32()),
                   pa.array(cols[4], pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                out, names = [*out, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return map_batches(rows, run, PIECES.format(kind=kind) + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset`` (and ``ids`` on request).

    Documents of more than ``capacity`` tokens are cut, the others stay whole;
    every sequence holds at most ``capacity`` tokens without gaps.  Null and
    empty texts are one piece of the closing id 0; repeated rows are packed
    each; an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    pieces = scratch_table(cut_pieces(docs, path, id_col=id_col, text_col=text_col, capacity=capacity, with_ids=with_ids))
    per_part = scratch_table(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    runs = spark.sparkContext.broadcast(plan_bins(counts, capacity))  # size depends on capacity, not on the corpus
    before = per_part.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = pieces.join(before, ["part", "length"])
    keep = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = numbered.select(*keep, (F.col("nth") + F.col("before")).alias("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = runs.value
        first_of = {}
        for size in np.unique(plan[:, 0]):
            lo, hi = np.searchsorted(plan[:, 0], [size, size + 1])
            first_of[int(size)] = (lo, plan[lo:hi, 1])
        for b in batches:
            size = b.column("length").to_numpy(zero_copy_only=False)
            nth = b.column("nth").to_numpy(zero_copy_only=False)
            at = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                mine = size == s
                lo, firsts = first_of[int(s)]
                at[mine] = lo + np.searchsorted(firsts, nth[mine], "right") - 1
            run = plan[at]
            k = nth - run[:, 1]
            names = [n for n in b.schema.names if n != "nth"]
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in names] + [pa.array(run[:, 3] + k // run[:, 4], pa.int64()),
                                                pa.array(run[:, 5] + k % run[:, 4] * size, pa.int64())],
                [*names, "sequence_id", "offset"])

    kind = dict(docs.dtypes)[id_col]
    out = map_batches(rows, place, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
                      + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
