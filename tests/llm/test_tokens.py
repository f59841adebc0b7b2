"""Operators 1, 6 and 8 against the public tokenizer libraries."""
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fareflow.llm import bpe_codec, packing, token_counts
from fareflow.llm.queries import QUERIES, vocabulary

from ..conftest import SMALL
from .conftest import EDGE_ROWS, by_id

WORD, PIECE = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = [r[1] or "" for r in EDGE_ROWS]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def strange(n, seed):
    rng = random.Random(seed)
    alphabet = list("  \n\tabtheé́中🙂'/.,0019\x00\x1c\x85 ▁\xa0ßAİΣς«×²½À") + ["'s", "'RE", "ing", "<|endoftext|>", "<s>", "</s>", "    ", "aaaa", "....", "The"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_counts_match_the_library(pieces):
    c = token_counts.counter(PIECE)
    for t in strange(4000, 1) + TEXTS:
        assert c.count(t) == len(pieces.encode(t)), t


def test_encoders_match_the_library(library):
    codec, enc = bpe_codec.codec(WORD), packing.encoder(WORD)
    for t in strange(4000, 2) + TEXTS:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == ids, t
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids, t
        assert codec.decode_ids(ids) == library.decode(ids, skip_special_tokens=False)


def test_caches_are_bounded_and_harmless(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe_codec, "CACHE_WORDS", 5)
    enc, codec = packing._WordIds(WORD), bpe_codec.WordBpe(WORD)
    for t in strange(200, 3):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids == np.frombuffer(codec.encode(t), "<u4").tolist()
    assert len(enc.ids_of) <= 5 and len(codec.ids_of) <= 5


def test_count_query_rows(spark, pieces):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = [(d.doc_id, len(d.text.encode()), n := len(pieces.encode(d.text)), n > 4096) for d in docs]
    assert by_id(QUERIES["op6_token_counts"](spark, SMALL).collect()) == by_id(want)


def test_codec_query_rows(spark, library):
    want = []
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = library.encode(d.text, add_special_tokens=False).ids
        want.append((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_id(QUERIES["op8_bpe_codec"](spark, SMALL).collect()) == by_id(want)


def check_packing(rows, texts, library, capacity=2048):
    """Every document is cut and placed whole, sequences are gapless and within the capacity; returns their number."""
    ids = {k: library.encode(t, add_special_tokens=False).ids + [0] for k, t in texts}
    sequences, seen = {}, Counter()
    for r in rows:
        mine = ids[r.doc_id][r.start: r.start + r.length]
        assert r.start == capacity * r.piece and len(mine) == r.length
        assert zlib.crc32(np.array(mine, "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {k: len(v) * n for (k, v), n in zip(ids.items(), [sum(x == k for x, _ in texts) for k in ids])}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    return len(rooms)


def test_packing_query(spark, library):
    rows = QUERIES["op1_best_fit_packing"](spark, SMALL).collect()
    texts = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert check_packing(rows, texts, library) == one_by_one([r.length for r in rows], 2048)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 50, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.choice([1, 2, capacity // 2, capacity // 3 + 1]) for _ in range(rng.randint(0, 200))]
    runs = packing.plan_bins(Counter(lengths), capacity)
    fill = Counter()
    placed = Counter()
    for size, first, n, bin0, each, offset in sorted(runs.tolist(), key=lambda r: (-r[0], r[1])):   # as they were placed
        placed[size] += n
        for i in range(n):
            assert fill[bin0 + i // each] == offset + i % each * size
            fill[bin0 + i // each] += size
    assert placed == Counter(lengths) and all(v <= capacity for v in fill.values())
    assert len(fill) == one_by_one(lengths, capacity)


def test_edge_rows(spark, edge, empty, library):
    texts = [(r[0], r[1] or "") for r in EDGE_ROWS]
    assert by_id(token_counts.count_tokens(edge, PIECE).select("doc_id", "n_bytes").collect()) == by_id([(k, len(t.encode())) for k, t in texts])
    rows = bpe_codec.encode_decode(edge, WORD).collect()
    assert by_id((r.doc_id, r.decoded) for r in rows) == by_id(
        (k, library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for k, t in texts)
    assert bpe_codec.encode_digest(edge, WORD).count() == len(EDGE_ROWS)
    known = [(k, t) for k, t in texts if k is not None]
    rows = packing.pack(edge.where("doc_id is not null"), WORD, with_ids=True).collect()
    check_packing(rows, known, library)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert sum(r.doc_id is None for r in packing.pack(edge, WORD).collect()) == 2
    for out in (token_counts.count_tokens(empty, PIECE), bpe_codec.encode_digest(empty, WORD), bpe_codec.encode_decode(empty, WORD), packing.pack(empty, WORD)):
        assert out.count() == 0
