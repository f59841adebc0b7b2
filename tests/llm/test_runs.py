"""Operator 11 against runs worked out period by period."""
import hashlib
import random
import re
import zlib

import pytest

from fareflow.llm import word_runs
from fareflow.llm.queries import QUERIES, repeat_words

from ..conftest import SMALL
from .conftest import EDGE_ROWS, by_id


def plain_runs(words, shortest=12):
    """(start, end, period) of every run: all periods, word by word."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q), q)          # smaller periods come first
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def plain_row(doc_id, text):
    """The row of the query, by its definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(12):
        n, kinds = rng.choice([0, 1, 5, 12, 13, 40, 150]), rng.choice([1, 2, 3, 5, 30])
        w = [str(rng.randint(1, kinds)).encode() for _ in range(n)]
        if n and rng.random() < 0.6:
            s = rng.randrange(n)
            p = 1 + (n - s) // rng.randint(2, 9)
            w = [w[i] if i < s else w[s + (i - s) % p] for i in range(n)]
        docs.append(w)
    shortest = rng.choice([12, 12, 2, 5])
    assert [[tuple(r) for r in x.tolist()] for x in word_runs.batch_runs(docs, shortest)] == [plain_runs(d, shortest) for d in docs]


def test_members_are_looked_up_in_blocks(monkeypatch):
    docs = [[b"ab"[i % 2: i % 2 + 1] for i in range(300)], [bytes([97 + i % 7]) for i in range(500)] + [b"z"] * 40]
    want = [x.tolist() for x in word_runs.batch_runs(docs)]
    monkeypatch.setattr(word_runs, "BLOCK", 5)
    assert [x.tolist() for x in word_runs.batch_runs(docs)] == want == [[[0, 300, 2]], [[0, 500, 7], [500, 540, 1]]]


def test_query_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = [plain_row(d.doc_id, d.text) for d in docs if len(d.text) < 8000]
    kept = {r[0] for r in want}
    rows = QUERIES["op11_periodic_runs"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    assert by_id(r for r in rows if r.doc_id in kept) == by_id(want)


def test_edge_rows(spark, edge, empty):
    rows = word_runs.detect(edge, prepare=repeat_words).collect()
    assert len(rows) == len(EDGE_ROWS) and word_runs.detect(empty).count() == 0
    for r in word_runs.detect(edge).collect():
        if r.n_words < 100:
            text = next(t for k, t, *_ in EDGE_ROWS if k == r.doc_id and len((t or "").encode().split()) == r.n_words)
            words = (text or "").encode().split()
            assert [(x.start, x.start + x.length, x.period) for x in r.runs] == plain_runs(words)
        else:                                             # a sentence of 18 words 4,000 times
            assert [tuple(x) for x in r.runs] == [(0, 72_000, 18)] and r.collapsed.split() == r.collapsed.split()[:18]
    assert by_id((r.n_words, len(r.runs), r.collapsed) for r in rows if r.doc_id in (1, 2, 7)) == [(0, 0, "")] * 3


def test_words_are_parted_at_ascii_white_space_only(spark):
    text = " ".join(["a\x1cb\x85c d", "e"] * 8) + "\x0b\x0c\r\nend"
    row = word_runs.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 17 and [tuple(x) for x in row.runs] == [(0, 16, 2)] and row.collapsed == "a\x1cb\x85c d e end"
