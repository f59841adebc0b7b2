"""Operator 13: hierarchical multi-length packing of documents into sequences.

Context sizes are tiers, powers of two from the longest down.  A document is
cut into whole windows of the longest tier and one rest, which is routed to the
smallest tier that holds it.  Pieces of one length are interchangeable, so the
whole plan is worked out on the histogram of lengths, which has as many rows as
the longest tier has places, at any corpus size:

1. *Pack each tier, fill gaps from shorter ones*: lengths are taken longest
   first.  A piece goes to the tightest gap of the windows of its own and the
   longer tiers (a segment tree over gaps, windows of equal gap taken
   together); only if there is none, a window of its own tier is opened.
2. *Close what gaps remain*: the windows with the least content are given up,
   and their pieces, one after the other, are poured into the gaps of the
   others, cut where a gap ends.  What is left over (less than a window)
   becomes sequences of powers of two.  So every sequence is full up to a power
   of two, and only pieces of given-up windows are cut.
3. *Balance step groups*: a step holds sequences of one length, about
   ``step_tokens`` tokens in all; the steps of all lengths are interleaved
   evenly, so any stretch of steps has the corpus' mix of lengths.

The plan is a few thousand ranges: numbers of pieces of a length -> windows or
stretches of the poured pieces.  A piece finds its place by arithmetic from its
number among the pieces of its length, a prefix sum over partitions, so no task
gathers the pieces of a length that most documents share.  Texts are tokenized
once; the ids of the rests (two bytes each, if the vocabulary allows) are kept
as a table until the plan is known.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, map_batches, scratch_table, whole_text
from .packing import OpenBins

TIERS = (1024, 512, 256, 128, 64)
STEP_TOKENS = 1 << 16
#: Distinct words kept per process.
CACHE_WORDS = 400_000


# The tokenizer's word pattern, for text of Latin-1 characters.
_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+"
                   rf"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: A place where a word ends in any text: the tokenizer lets white space begin a word, never end one.
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def words(text: str) -> list[str]:
    """Parts of a text that the tokenizer encodes apart from each other: its
    words in Latin-1 text without special strings, else what white space parts."""
    if "<|" not in text:
        try:
            text.encode("latin-1")
            return _WORD.findall(text)
        except UnicodeEncodeError:
            pass
    return _CUT.split(text)


class ByteLevelIds:
    """Ids of texts by the tokenizers library, one call per distinct word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind = "H" if self.narrow else "I"
        self.ids_of = Recent(self._encode, CACHE_WORDS)

    def _encode(self, piece: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, words(text))), f"<u{2 if self.narrow else 4}")


_ENCODERS: dict[str, ByteLevelIds] = {}


def encoder(path: str) -> ByteLevelIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelIds(path)
    return _ENCODERS[path]


class Plan:
    """Where the pieces of every length go.

    ``pieces``: rows (length, first piece, poured, window or place in the
    stream, pieces per window, offset), sorted by length and first piece.
    ``gaps``: rows (place in the stream, room, window, offset), sorted.
    ``windows``: rows (first window, first sequence, sequence length), sorted.
    """

    def __init__(self, counts: dict[int, int], tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tuple(sorted(tiers, reverse=True)), step_tokens
        rows, opened, bins = self._fill(counts)
        self._close(rows, opened, bins)

    def _fill(self, counts):
        """Longest first into the tightest gaps; rows (length, first piece,
        pieces, first window, pieces per window, offset) and windows opened."""
        bins, rows, starts, sizes, n_windows = OpenBins(self.tiers[0]), [], [], [], 0
        for length in sorted(counts, reverse=True):
            done, n = 0, counts[length]
            while done < n:
                room = bins.tightest(length)
                if room is None:
                    room = next(t for t in reversed(self.tiers) if t >= length)
                    first, have = n_windows, -(-(n - done) // (room // length))
                    starts.append(first)
                    sizes.append(room)
                    n_windows += have
                else:
                    first, have = bins.take(room)
                offset = sizes[bisect_right(starts, first) - 1] - room
                each = room // length
                full = min(have, (n - done) // each)
                if full:
                    rows.append((length, done, full * each, first, each, offset))
                    bins.put(room - each * length, first, full)
                    done += full * each
                rest = n - done if full < have and n - done < each else 0
                if rest:
                    rows.append((length, done, rest, first + full, rest, offset))
                    bins.put(room - rest * length, first + full, 1)
                    done += rest
                    full += 1
                bins.put(room, first + full, have - full)
        return rows, list(zip(starts, sizes, np.diff([*starts, n_windows]).tolist())), bins

    def _close(self, rows, opened, bins):
        starts = [o[0] for o in opened]
        gaps, kinds = [], []                                     # kinds: (first window, windows, sequence length; 0 if given up)
        for room, ranges in bins.runs.items():
            for first, n in ranges:
                content = opened[bisect_right(starts, first) - 1][1] - room
                if content & (content - 1):
                    gaps.append((content, first, n, room))
                else:                                            # a power of two already
                    kinds.append((first, n, content))
        gaps.sort()
        need, have, kept = sum(n * room for _, _, n, room in gaps), 0, []
        for content, first, n, room in gaps:
            give = min(n, max(0, -(-(need - have) // (content + room))))
            need, have = need - give * room, have + give * content
            if give:
                kinds.append((first, give, 0))
            if give < n:
                kinds.append((first + give, n - give, content + room))
                kept.append((room, first + give, n - give, content))
        n_windows = opened[-1][0] + opened[-1][2] if opened else 0
        # Gaps in the order in which they are filled, then what is left over as powers of two.
        places, at = [], 0
        for room, first, n, content in sorted(kept, reverse=True):
            places.append((at, room, first, content))
            at += room * n
        left = have - at
        for bit in range(left.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                places.append((at, 1 << bit, n_windows, 0))
                kinds.append((n_windows, 1, 1 << bit))
                at += 1 << bit
                n_windows += 1
        self.gaps = np.array(places, np.int64).reshape(-1, 4)
        # Pieces of given-up windows, in the order in which they are poured.
        given = sorted((first, first + n) for first, n, length in kinds if not length)
        pieces, at = [], 0
        for length, first_piece, n, window, each, offset in rows:
            end, w = window + -(-n // each), window
            while w < end:
                i = bisect_right(given, (w, n_windows + 1)) - 1
                inside = i >= 0 and w < given[i][1]
                stop = min(end, given[i][1] if inside else given[i + 1][0] if i + 1 < len(given) else end)
                a, b = (w - window) * each, min(n, (stop - window) * each)
                if inside:
                    pieces.append((length, first_piece + a, 1, at, 0, 0))
                    at += (b - a) * length
                else:
                    pieces.append((length, first_piece + a, 0, w, each, offset))
                w = stop
        self.pieces = np.array(sorted(pieces), np.int64).reshape(-1, 6)
        # Windows that stay, numbered by sequence length, longest first.
        marked = sorted(kinds)
        for first, size, n in opened:
            at = first
            for f, m, _ in marked[bisect_right(marked, (first,)):]:
                if f >= first + n:
                    break
                if f > at:
                    kinds.append((at, f - at, size))
                at = f + m
            if at < first + n:
                kinds.append((at, first + n - at, size))
        windows, self.lengths, self.counts, total = [], [], [], 0
        for first, n, length in sorted((k for k in kinds if k[2]), key=lambda k: (-k[2], k[0])):
            if not self.lengths or self.lengths[-1] != length:
                self.lengths.append(length)
                self.counts.append(0)
            windows.append((first, total, length))
            self.counts[-1] += n
            total += n
        self.windows = np.array(sorted(windows), np.int64).reshape(-1, 3)

    def sequences(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence number and length of windows."""
        at = self.windows[np.searchsorted(self.windows[:, 0], window, "right") - 1]
        return window - at[:, 0] + at[:, 1], at[:, 2]

    def steps(self, sequence: np.ndarray) -> np.ndarray:
        """Step of each sequence: step k of n of its length stands at
        (k + 1/2) / n of the way, longer sequences first at equal places."""
        first = np.cumsum([0, *self.counts])
        per = np.array([max(1, self.step_tokens // n) for n in self.lengths], np.int64)
        total = -(-np.array(self.counts, np.int64) // per)
        kind = np.searchsorted(first, sequence, "right") - 1
        k, n = (sequence - first[kind]) // per[kind], total[kind]
        out = np.zeros(len(sequence), np.int64)
        for c, m in enumerate(total.tolist()):
            x = (2 * k + 1) * m - n                              # steps j of c with (2j + 1) * n before (2k + 1) * m
            before = np.where(c < kind, x // (2 * n) + 1, -(-x // (2 * n)))
            out += np.where(c == kind, k, np.clip(before, 0, m))
        return out


def cut_rests(docs: DataFrame, path: str, *, id_col: str, text_col: str, longest: int) -> DataFrame:
    """Whole windows (``ids`` null) and rest of every document; ``nth`` numbers
    pieces of a length within the partition ``part``."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from fareflow.llm.tier_packing import encoder

        enc, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        end = np.zeros(1, np.uint16 if enc.narrow else np.uint32)
        for b in batches:
            which, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.concatenate([enc.encode(text), end])
                wide = ids.astype("<u4").tobytes()
                for at in range(0, len(ids), longest):
                    n = min(longest, len(ids) - at)
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    which.append(i)
                    rows.append((len(ids), at, n, zlib.crc32(wide[4 * at: 4 * (at + n)]), part, nth,
                                 None if n == longest else ids[at: at + n].tobytes()))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *map(pa.array, cols, kinds)],
                                             ["id", "doc_tokens", "start", "length", "ids_crc32", "part", "nth", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return map_batches(rows, run, f"id {kind}, doc_tokens long, start long, length long, ids_crc32 long, part int, nth long, ids binary")


def place_pieces(plan: Plan, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of pieces, cut where the plan cuts them: which piece, start
    in it, length, window, offset in the window."""
    firsts = {int(n): np.searchsorted(plan.pieces[:, 0], [n, n + 1]) for n in np.unique(length)}
    at = np.zeros(len(length), np.int64)
    for n, (lo, hi) in firsts.items():
        mine = length == n
        at[mine] = lo + np.searchsorted(plan.pieces[lo:hi, 1], nth[mine], "right") - 1
    row = plan.pieces[at]
    k, poured = nth - row[:, 1], row[:, 2] == 1
    whole = np.flatnonzero(~poured)
    each = row[whole, 4]
    parts = [[whole, np.zeros(len(whole), np.int64), length[whole], row[whole, 3] + k[whole] // each, row[whole, 5] + k[whole] % each * length[whole]]]
    left = np.flatnonzero(poured)
    place, done = row[left, 3] + k[left] * length[left], np.zeros(len(left), np.int64)
    while len(left):                                             # a round fills one gap of each piece
        gap = plan.gaps[np.searchsorted(plan.gaps[:, 0], place, "right") - 1]
        inside = (place - gap[:, 0]) % gap[:, 1]
        take = np.minimum(length[left] - done, gap[:, 1] - inside)
        parts.append([left, done, take, gap[:, 2] + (place - gap[:, 0]) // gap[:, 1], gap[:, 3] + inside])
        more = done + take < length[left]
        left, place, done = left[more], (place + take)[more], (done + take)[more]
    return tuple(np.concatenate(c) for c in zip(*parts))


def pack_tiers(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
               tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: id, ``start`` (the document's ids before it),
    ``length``, ``ids_crc32``, ``doc_tokens`` (ids of the text and the closing
    id 0), ``sequence_id``, ``offset``, ``context`` (length of the sequence, a
    power of two; nothing is padded) and ``step``.

    Null and empty texts are one closing id; repeated rows and null ids are
    packed each; an empty table gives an empty result; further columns are
    ignored.  ``tiers`` are powers of two.
    """
    spark, longest = docs.sparkSession, max(tiers)
    pieces = scratch_table(cut_rests(docs, path, id_col=id_col, text_col=text_col, longest=longest))
    per_part = scratch_table(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= longest tier's rows
    shared = spark.sparkContext.broadcast(Plan(counts, tiers, step_tokens))  # size depends on the tiers, not on the corpus
    before = per_part.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = pieces.join(before, ["part", "length"]).select(
        "id", "doc_tokens", "start", "length", "ids_crc32", "ids", (F.col("nth") + F.col("before")).alias("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.tier_packing import encoder, place_pieces

        plan, width = shared.value, "<u2" if encoder(path).narrow else "<u4"
        for b in batches:
            length, nth = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            which, start, n, window, offset = place_pieces(plan, length, nth)
            sequence, context = plan.sequences(window)
            crc = b.column("ids_crc32").to_numpy(zero_copy_only=False)[which]
            for i in np.flatnonzero(n < length[which]).tolist():
                ids = np.frombuffer(b.column("ids")[int(which[i])].as_py(), width)[start[i]: start[i] + n[i]]
                crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
            took = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(took), pa.array(start + b.column("start").to_numpy(zero_copy_only=False)[which]), pa.array(n), pa.array(crc),
                 b.column("doc_tokens").take(took), *map(pa.array, (sequence, offset, context, plan.steps(sequence)))],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step"])

    kind = dict(docs.dtypes)[id_col]
    out = map_batches(numbered, place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
                                       "context long, step long")
    return out.withColumnRenamed("id", id_col)
