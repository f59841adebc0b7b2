"""Operator 13: every id is placed once, sequences are full, steps are even."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fareflow.llm import tier_packing
from fareflow.llm.queries import QUERIES, vocabulary

from ..conftest import SMALL
from .conftest import EDGE_ROWS
from .test_tokens import strange

BYTE = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BYTE)


def test_encoder_matches_the_library(library, monkeypatch):
    monkeypatch.setattr(tier_packing, "CACHE_WORDS", 50)
    enc = tier_packing.ByteLevelIds(BYTE)
    white = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rng = random.Random(7)
    mixed = ["".join(rng.choice(white + ["a", "B1", "!", "é", "'s", "<|endoftext|>", "中"]) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for t in strange(4000, 4) + mixed + [r[1] or "" for r in EDGE_ROWS]:
        assert enc.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def placed(lengths, tiers, step_tokens):
    counts = Counter(lengths)
    plan = tier_packing.Plan(counts, tiers, step_tokens)
    length = np.array([n for n in counts for _ in range(counts[n])], np.int64)
    nth = np.array([i for n in counts for i in range(counts[n])], np.int64)
    which, start, n, window, offset = tier_packing.place_pieces(plan, length, nth)
    sequence, context = plan.sequences(window)
    return plan, length, list(zip(which.tolist(), start.tolist(), n.tolist(), sequence.tolist(), offset.tolist(), context.tolist()))


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    """Pieces are whole, sequences gapless and full, steps numbered densely and of one length each."""
    rng = random.Random(seed)
    tiers = rng.choice([(16, 8, 4), (64, 32, 16, 8), (8,), (4, 32)])
    top = max(tiers)
    lengths = [rng.randint(1, top) if rng.random() < 0.7 else rng.choice([1, top, top // 2 + 1, 3]) for _ in range(rng.randint(1, 200))]
    plan, length, rows = placed(lengths, tiers, 4 * top)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for i, start, n, sequence, offset, context in rows:
        pieces[i].append((start, n))
        sequences[sequence].append((offset, n, context))
    for i, n in enumerate(length.tolist()):
        ends = [0] + [a + b for a, b in sorted(pieces[i])]
        assert [a for a, _ in sorted(pieces[i])] == ends[:-1] and ends[-1] == n
    for parts in sequences.values():
        ends = [0] + [a + b for a, b, _ in sorted(parts)]
        assert [a for a, *_ in sorted(parts)] == ends[:-1] and ends[-1] == parts[0][2]
        assert ends[-1] <= top and ends[-1] & (ends[-1] - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    steps = defaultdict(list)
    for q, step in enumerate(plan.steps(np.arange(len(sequences))).tolist()):
        steps[step].append(sequences[q][0][2])
    assert sorted(steps) == list(range(len(steps)))
    assert all(len(set(x)) == 1 and sum(x) <= 4 * top for x in steps.values())


def test_steps_mix_lengths_evenly():
    rng = random.Random(1)
    plan, _, rows = placed([min(1024, int(rng.expovariate(1 / 200)) + 1) for _ in range(60_000)], tier_packing.TIERS, 1 << 14)
    steps = plan.steps(np.arange(sum(plan.counts)))
    of = dict(zip(steps.tolist(), np.repeat(plan.lengths, plan.counts).tolist()))
    whole = Counter(of.values())
    tenth = len(of) // 10
    for lo in range(0, 10 * tenth, tenth):
        part = Counter(of[s] for s in range(lo, lo + tenth))
        assert all(abs(part[n] - whole[n] / 10) <= 1.5 for n in whole)


def test_few_pieces_are_cut():
    rng = random.Random(2)
    _, length, rows = placed([rng.randint(1, 1024) for _ in range(50_000)], tier_packing.TIERS, 1 << 16)
    assert len(rows) < 1.05 * len(length)
    plan, _, _ = placed([700] * 9000 + [30] * 9000, tier_packing.TIERS, 1 << 16)
    assert len(plan.pieces) < 50                        # ranges, not pieces


def check_rows(rows, texts, library):
    ids = {k: library.encode(t, add_special_tokens=False).ids + [0] for k, t in texts}
    seen, sequences = defaultdict(Counter), defaultdict(list)
    for r in rows:
        mine = ids[r.doc_id][r.start: r.start + r.length]
        assert len(mine) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(mine, "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id].update(range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.context))
    copies = Counter(k for k, _ in texts)
    assert {k: set(v.values()) for k, v in seen.items()} == {k: {n} for k, n in copies.items()}
    assert {k: len(v) for k, v in seen.items()} == {k: len(v) for k, v in ids.items()}
    for parts in sequences.values():
        ends = [0] + [a + b for a, b, _ in sorted(parts)]
        assert [a for a, *_ in sorted(parts)] == ends[:-1] and ends[-1] == parts[0][2] <= 1024


def test_query_rows(spark, library):
    texts = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_rows(QUERIES["op13_tier_packing"](spark, SMALL).collect(), texts, library)


def test_edge_rows(spark, edge, empty, library):
    known = [(r[0], r[1] or "") for r in EDGE_ROWS if r[0] is not None]
    check_rows(tier_packing.pack_tiers(edge.where("doc_id is not null"), BYTE).collect(), known, library)
    assert sum(r.doc_id is None and r.start == 0 for r in tier_packing.pack_tiers(edge, BYTE).collect()) == 2
    assert tier_packing.pack_tiers(empty, BYTE).count() == 0
