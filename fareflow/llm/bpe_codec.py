"""Operator 8: BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the last token of its BPE encoding is unique: it
is the one vocabulary match ending there whose predecessor (the last token of
the prefix before it) it may follow.  Matches come from an automaton over the
vocabulary (suffix links list all tokens that end at a position); whether two
tokens may stand side by side is told from their merge ranks alone: no merge
across their border may come before the merges that made them.  Following
the back-pointers from the end of the word gives the ids.  No merge loop runs
over the word.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, map_batches, whole_text
from .word_bpe import load_json, words

#: Distinct words kept per process.
CACHE_WORDS = 150_000
#: Word-final symbols are their own alphabet: the code point moved up by this.
FINAL = 0x10000
_NEVER = 1 << 60


class WordBpe:
    """Encoder and decoder of a ``tokenizers`` BPE file with word ends."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = load_json(path)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        if spec.get("decoder") is not None or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError("unknown kind of tokenizer file")
        vocab: dict[str, int] = model["vocab"]
        size = max(vocab.values()) + 1
        #: How each token was made: rank of its merge (-1: a symbol), left and right part.
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ia, ib, t = vocab[a], vocab[b], vocab[a + b]
            if (ia, ib) not in self.pair:
                self.pair[ia, ib] = r
                if self.rank[t] < 0:
                    self.rank[t], self.left[t], self.right[t] = r, ia, ib
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            symbols = self._symbols(text)
            if symbols and (len(symbols) == 1 or self.rank[i] >= 0):
                self.automaton.add_word(symbols, (len(symbols), i))
        self.automaton.make_automaton()
        tok = Tokenizer.from_file(path)
        self.normalize, self.split_words = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.shown = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.beside: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.ids_of = Recent(lambda piece: array("I", self.encode_piece(piece)).tobytes(), CACHE_WORDS)

    def _symbols(self, token: str) -> str:
        """A token as a string over symbols; the word-final symbol carries the end."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + FINAL)
        return token

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between tokens ``a`` and ``b`` alone.

        Both are taken apart along the border, latest merge first.  At each
        moment the symbols at the border must have no merge that comes before
        the next merge of either: of equal ranks the left one comes first.
        """
        known = self.beside.get((a, b))
        if known is not None:
            return known
        x, y, ends_x, ends_y = a, b, _NEVER, _NEVER
        rank = self.rank
        while True:
            r = self.pair.get((x, y), _NEVER)
            if r < ends_x and r <= ends_y and r != _NEVER:
                ok = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                ok = True
                break
            if rx > ry:
                x, ends_x = self.right[x], rx
            else:
                y, ends_y = self.left[y], ry
        if len(self.beside) >= 2_000_000:
            self.beside.clear()
        self.beside[a, b] = ok
        return ok

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word (byte symbols) by the prefix table."""
        s = word[:-1] + chr(ord(word[-1]) + FINAL)
        n = len(s)
        last: list[int] = [-1] * (n + 1)                # last token of the prefix of each length
        back: list[int] = [0] * (n + 1)
        follows = self.may_follow
        for end, (size, token) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start == 0:
                if self._whole(token):
                    last[end], back[end] = token, 0
            elif last[start] >= 0 and follows(last[start], token):
                last[end], back[end] = token, start
        ids, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError(f"no encoding of {word!r}")
            ids.append(last[at])
            at = back[at]
        return tuple(reversed(ids))

    def _whole(self, token: int) -> bool:
        """Whether BPE of the token's own symbols gives the token back: its
        parts do, and their border stays open until its own merge."""
        if self.rank[token] < 0:
            return True
        known = self.whole.get(token)
        if known is None:
            a, b = self.left[token], self.right[token]
            known = self.whole[token] = (self._whole(a) and self._whole(b)
                                         and self._border_until(a, b, self.rank[token]))
        return known

    def _border_until(self, a: int, b: int, rank: int) -> bool:
        """Like ``may_follow``, for merges before ``rank``."""
        x, y, ends_x, ends_y = a, b, rank, rank - 1
        while True:
            r = self.pair.get((x, y), _NEVER)
            if (x, y) != (a, b) and r < ends_x and r <= ends_y:
                return False
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x, ends_x = self.right[x], rx
            else:
                y, ends_y = self.left[y], ry

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a part of a text without white space; special strings are matched first."""
        ids: list[int] = []
        for part in self.special_at.split(piece):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word, _ in self.split_words(self.normalize(part)):
                    ids += self.encode_word(word)
        return ids

    def decode_ids(self, ids) -> str:
        """Tokens joined by blanks: the file names no decoder."""
        return " ".join(map(self.shown.__getitem__, ids))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.ids_of.__getitem__, words(text)))


_CODECS: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """The process's codec of one tokenizer file."""
    if path not in _CODECS:
        _CODECS[path] = WordBpe(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` (array of int) and ``decoded`` text.

    Null and empty texts have no ids and an empty decoded text; repeated rows
    give repeated rows; an empty table gives an empty result; further columns
    are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.bpe_codec import codec

        c = codec(path)
        for b in batches:
            ids = [np.frombuffer(c.encode(t), "<u4") for t in b.column(1).to_pylist()]
            decoded = [c.decode_ids(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return map_batches(rows, run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digest(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_decode`` with digests instead of the ids and the text: id,
    ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit
    integers), ``decoded_sha256`` (UTF-8).  Same edge cases."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.bpe_codec import codec

        c = codec(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode_ids(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = map_batches(rows, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
