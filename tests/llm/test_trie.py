"""Operator 12 against a trie of nested dictionaries."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fareflow.llm import conversation_trie
from fareflow.llm.queries import QUERIES

from ..conftest import SMALL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_nodes(convs):
    """Rows of all nodes of ``convs`` (id -> list of (role, text)), prefix by prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    rows = []
    for p, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(p))))
        rows.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), leaves[p], saved[p],
                     hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def by_turn(rows):
    """id -> turns, of rows (conv_id, turn, role, text)."""
    out = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out[c].append((role or "", text or ""))
    return dict(out)


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def same(got, want):
    assert [f for f in got.columns] == COLUMNS
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert order(got.collect()) == order(want)


def made(seed, n=200):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 3000), n):
        kind = rng.random()
        length = 3 if kind < 0.3 else rng.choice([1, 1, 2, 3, 4, 8, 30])
        for t in range(length):
            text = "hot" if kind < 0.3 else rng.choice(["", "a", "b", "a long text é🙂", None, f"{rng.randint(0, 9)}"])
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["user", None]) if t == 1 else "user", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shards,ids", [(1, 1, 7), (2, 3, 2), (3, 7, 20_000), (4, 60, 3), (5, 200, 1)])
def test_nodes_equal_brute_force(spark, monkeypatch, seed, shards, ids):
    """Shards of any number, hot sequences over several of them, ids in pieces."""
    rows = made(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(conversation_trie.trie(conversation_trie.sequences(df), shards=shards), plain_nodes(by_turn(rows)))


def test_query(spark, tmp_path):
    for rows in (made(6, 400), [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]):
        rows = [r for r in rows if r[0] >= 0]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        same(QUERIES["op12_conversation_trie"](spark, str(tmp_path)), plain_nodes(rebuilt(by_turn(rows))))


def test_shard_borders():
    """All cuts of a sorted list into shards give the nodes of the whole, ids in pieces of two."""
    rng = random.Random(9)
    convs = {c: [(("user"), rng.choice("ab")) for _ in range(rng.randint(0, 5))] for c in range(60)}
    code = {t: hashlib.sha256(t.encode()).digest()[:16] + len(t).to_bytes(4, "big") for t in "ab"}
    pairs = sorted((b"".join(code[t] for _, t in turns), c) for c, turns in convs.items())
    want = sorted(plain_nodes(convs), key=repr)
    before = conversation_trie.IDS
    conversation_trie.IDS = 2
    try:
        for shards in range(1, 25):
            cuts = sorted(rng.sample(range(1, len(pairs)), shards - 1))
            inner, border = [], []
            for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(pairs)])):
                paths, ids = [], []
                for p, c in pairs[a:b]:
                    if not paths or paths[-1] != p:
                        paths.append(p)
                        ids.append(conversation_trie.array("q"))
                    ids[-1].append(c)
                for r in conversation_trie.shard_rows(paths, ids, k):
                    (border if r["kind"] else inner).append(r)
            merged = list(conversation_trie.merged_rows(iter(border)))
            found = {r["key"]: r["conv_id"] for r in merged}
            got = [tuple(r.get(c) if c != "parent_conv_id" or r.get(c) is not None else found.get(r["parent_key"]) for c in COLUMNS) for r in inner + merged]
            assert sorted(got, key=repr) == want
    finally:
        conversation_trie.IDS = before


def test_siblings_are_balanced():
    tree = conversation_trie.Tree()
    for i in conversation_trie.medians(1023):
        tree.insert([i, 5])
    depth, todo = 0, [(tree.equal[0], 1)]
    while todo:
        node, d = todo.pop()
        if node:
            depth = max(depth, d)
            todo += [(tree.low[node], d + 1), (tree.high[node], d + 1)]
    assert depth == 10 and sorted(conversation_trie.medians(17)) == list(range(17))


def test_edge_rows(spark):
    schema = "conv_id long, turn long, role string, text string, codes string, path int, key string, depth int, base int, h int"
    rows = [(None, 1, "user", "x"), (1, 0, None, None), (1, 0, None, None), (2, None, "user", "x" * 300_000), (2, 5, "ab", "c"), (3, None, "user", "x" * 300_000),
            (3, 5, "a", "bc"), (4, 1, "", "")]
    df = spark.createDataFrame([(*r, "q", 1, "k", 2, 3, 4) for r in rows], schema)
    same(conversation_trie.trie(conversation_trie.sequences(df), shards=4), plain_nodes(by_turn([r for r in rows if r[0] is not None])))
    none = spark.createDataFrame([(7, [])], "conv_id long, codes array<string>")
    same(conversation_trie.trie(none), plain_nodes({7: []}))
    assert conversation_trie.trie(conversation_trie.sequences(df.limit(0))).count() == 0
    assert conversation_trie.trie(conversation_trie.sequences(df.where(F.col("conv_id").isNull()))).count() == 0
