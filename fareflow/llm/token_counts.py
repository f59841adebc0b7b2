"""Operator 6: exact token counts by heap-and-linked-list pair merging.

A sentencepiece BPE model with byte fallback starts from the code points of
the escaped text and repeatedly merges the best-scored adjacent pair.  No
piece of such a model holds a word mark after another character, so merges
never cross a word start and each word is counted once per process and
looked up afterwards.  The count is the initial symbols minus the merges; no
ids are made.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, whole_text

MARK = "▁"
#: Words kept per process; the cache starts anew beyond it (memory bound, no effect on results).
CACHE_WORDS = 400_000


class PieceCounter:
    """Token counts of a sentencepiece BPE model, without begin or end tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.score) or any("\n" in p for p in self.score):
            raise ValueError("a piece crosses a word start; words can't be counted apart")
        self.after_mark, self.bare = _Counts(self, MARK), _Counts(self, "")

    def count_chunk(self, chunk: str) -> int:
        """Merge ``chunk`` (escaped, one word) and count what is left."""
        symbols: list[str] = list(chunk)
        cost = [1 if c in self.score else len(c.encode("utf-8", "surrogatepass")) for c in symbols]
        total, n = sum(cost), len(symbols)
        if n < 2:
            return total
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        heap = []
        score = self.score
        for i in range(n - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None:
                heap.append((-s, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(heap)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue                                # one side was merged meanwhile
            symbols[left], symbols[right] = a + b, ""
            total -= cost[left] + cost[right] - 1
            cost[left] = 1
            nxt = after[right]
            after[left] = nxt
            if nxt >= 0:
                before[nxt] = left
                s = score.get(symbols[left] + symbols[nxt])
                if s is not None:
                    heapq.heappush(heap, (-s, left, nxt, len(symbols[left]) + len(symbols[nxt])))
            prv = before[left]
            if prv >= 0:
                s = score.get(symbols[prv] + symbols[left])
                if s is not None:
                    heapq.heappush(heap, (-s, prv, left, len(symbols[prv]) + len(symbols[left])))
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, first_line = 0, True
        for line in text.replace(MARK, " ").split("\n"):
            words = line.split(" ")
            if first_line:
                first_line = False                      # the model puts one mark before the text
            else:
                total += 1 + self.bare[words[0]]        # the line feed is one byte token
                del words[0]
            if "" in words:
                words = _fold_blanks(words)
            total += sum(map(self.after_mark.__getitem__, words))
        return total


def _fold_blanks(words: list[str]) -> list[str]:
    """A run of blanks belongs to the word after it (or stands alone at the end)."""
    out, blanks = [], 0
    for w in words:
        if w:
            out.append(" " * blanks + w)
            blanks = 0
        else:
            blanks += 1
    if blanks:
        out.append(" " * (blanks - 1))
    return out


class _Counts(dict):
    """Counts of words that follow ``mark``, worked out on first use."""

    def __init__(self, counter: PieceCounter, mark: str):
        super().__init__()
        self.counter, self.mark = counter, mark

    def __missing__(self, word: str) -> int:
        n = self.counter.count_chunk(self.mark + word.replace(" ", MARK))
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model_path: str) -> PieceCounter:
    """The process's counter of one model file."""
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PieceCounter(model_path)
    return _COUNTERS[model_path]


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``
    (more than ``limit`` tokens).

    Null and empty texts count 0 tokens; repeated rows give repeated rows; a
    null id stays null; an empty table gives an empty result; further columns
    are ignored.  Texts are counted whole.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.token_counts import counter

        c = counter(model_path)
        for b in batches:
            n = pa.array([c.count(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["id", "n_bytes", "n_tokens"])

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = map_batches(rows, run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
