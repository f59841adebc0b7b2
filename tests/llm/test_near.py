"""Operators 4, 5 and 9 against brute force."""
import hashlib
import random

import numpy as np
import pytest
import regex

from fareflow.llm import hnsw, jaccard_join, spotsigs
from fareflow.llm.components import connected
from fareflow.llm.queries import QUERIES

from ..conftest import SMALL
from .conftest import EDGE_ROWS, SENTENCE, clashes_kept


# -- operator 5 -------------------------------------------------------------------
def shingles(text, n=5):
    w = regex.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return {tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(docs, threshold=0.8):
    """{row number: (class id, links)} of (id, text) rows."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if docs[i][1] == docs[j][1] or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    name = {}
    for i, (k, _) in enumerate(docs):
        name.setdefault(find(i), []).append(k)
    return [(docs[i][0], min((k for k in name[find(i)] if k is not None), default=None), links[i]) for i in range(len(docs))]


def rows_of(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows_of(QUERIES["op5_ngram_jaccard_join"](spark, SMALL)) == sorted(brute_classes(docs), key=str)


@pytest.fixture(scope="module")
def families(spark):
    """A large family of near copies (many blocks), exact copies, chains, short texts, unrelated texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, base = [], [word() for _ in range(60)]
    for k in range(150):
        copy = list(base)
        copy[rng.randrange(60)] = word()
        docs.append(" ".join(copy))
    docs += [" ".join(base)] * 20
    for _ in range(10):                                   # chains: neighbours are near, the ends are not
        chain = [word() for _ in range(80)]
        for step in range(5):
            chain = chain[4:] + [word() for _ in range(4)]
            docs.append(" ".join(chain))
    docs += [" ".join(word() for _ in range(40)) for _ in range(60)] + ["same short", "same short", "Same  SHORT!", "other short", "", "", "---", "***"]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("block", [2048, 16])
def test_families(spark, families, block):
    df = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    out = jaccard_join.near_duplicates(df, block_docs=block)
    assert rows_of(out) == sorted(brute_classes(families), key=str)
    kept = jaccard_join.keep_first(df, block_docs=block)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_classes(families)})


def test_blocks_that_the_hash_leaves_empty(spark):
    """Families of two long texts in two blocks each: in some, both texts are in one block."""
    rng, docs = random.Random(6), []
    for k in range(40):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + ["more"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows_of(jaccard_join.near_duplicates(df, block_chars=2000)) == sorted([(i, i - i % 2, 1) for i, _ in docs], key=str)


def test_climbing_ends_at_the_target_recall():
    depth = jaccard_join.shortest_prefix(0.8, 24, 8, 0.999)
    assert jaccard_join.recall_of(depth, 0.8, 24) >= 0.999 > jaccard_join.recall_of(depth + 1, 0.8, 24)
    assert jaccard_join.shortest_prefix(0.8, 24, 8, 0.9) > depth
    with pytest.raises(ValueError):
        jaccard_join.shortest_prefix(0.1, 1, 8, 0.999)


def test_subtrees_meet_level_by_level(spark):
    """Links connect exactly the nodes that share a shortest prefix, at every level through the subtrees' smallest nodes."""
    rng = random.Random(12)
    rows = []
    for node in range(200):
        for tree in range(3):
            value = [rng.randint(0, 4) for _ in range(4)]
            rows.append((node, tree, [hash((tree, *value[:d])) for d in (4, 3, 2)]))
    links = [(r.node, r.hub) for r in jaccard_join.climb(spark.createDataFrame(rows, "node long, tree int, path array<long>"), 3).collect()]
    assert all(hub < node for node, hub in links)
    for edges in (links, [(a, b) for a, t, p in rows for b, u, q in rows if t == u and p[2] == q[2] and b < a]):
        root = list(range(200))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        if edges is links:
            first = [find(x) for x in range(200)]
    assert first == [find(x) for x in range(200)]
    assert len(links) <= 3 * 200 + 3 * 3 * 25                # one link a node and trie, and a few of subtrees


def percolating(seed=13, families=60, n=8):
    """Texts that share five sixths of their words with others in long chains, and near copies among them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    part = [" ".join(word() for _ in range(20)) for _ in range(families + 5)]
    docs = []
    for k in range(families):
        base = " ".join(part[k: k + 6]).split()
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [2048, 5])
def test_texts_that_percolate_are_compared_by_subtree(spark, monkeypatch, block):
    docs = percolating()
    seen, plan = [], jaccard_join.parts_to_compare
    monkeypatch.setattr(jaccard_join, "parts_to_compare", lambda *a: (seen.append(plan(*a)), seen[-1])[1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows_of(jaccard_join.near_duplicates(df, block_docs=block)) == sorted(brute_classes(docs), key=str)
    size = [r["count"] for r in seen[0].groupBy("part").count().collect()]
    assert seen[0].where("part < 0").count() > 0              # there is a component that is not compared as a whole
    assert sum(n * n for n in size) < len(docs) ** 2


def test_planted_pairs_at_the_threshold_are_found(spark):
    """2,000 pairs just above the threshold, whose texts differ in runs of words: a recall of 0.999."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    docs, pairs = [], 0
    while pairs < 2000:
        a = [word() for _ in range(120)]
        b = a[:109] + [word() for _ in range(11)]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.84:
            docs += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    out = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert out.where("n_links = 1").count() / 4000 >= 0.998   # 0.999 expected, less chance


def test_join_edge_rows(spark, edge, empty):
    docs = [(r[0], r[1] or "") for r in EDGE_ROWS]
    assert rows_of(jaccard_join.near_duplicates(edge)) == sorted(brute_classes(docs), key=str)
    kept = jaccard_join.keep_first(edge)
    assert kept.columns == edge.columns and clashes_kept(kept)
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(True, k) for k in (1, 3, 4, 6, 7, 8, 9, 10, 11)]
    assert kept.where("doc_id is null").count() == 1      # the other null id has the text of document 1
    assert jaccard_join.near_duplicates(empty).count() == 0 and jaccard_join.keep_first(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {k: find(k) for k in root if find(k) != k}


# -- operator 9 -------------------------------------------------------------------
def spots(text):
    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]
    common = set(spotsigs.COMMON_WORDS)
    out = {(x, *[y for y in w[i + 1:] if y not in common][:2]) for i, x in enumerate(w) if x in common}
    return out or {tuple(w[i: i + 3]) for i in range(len(w))} or {text}


def check_fingerprints(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    for i, (k, t) in enumerate(docs):
        nxt, r, half = docs[(i + 1) % len(docs)][1], got[k], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = spots(t), spots(edited), spots(nxt)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
        assert len(r.fingerprint.split(",")) == len(a) and len(r.edited_fingerprint.split(",")) == len(b)
        assert r.is_near_edited == (r.near_edited >= spotsigs.NEAR) and r.is_near_next == (r.near_next >= spotsigs.NEAR)


def test_fingerprint_query(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 8000").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check_fingerprints(spotsigs.fingerprints(df).collect(), docs)
    rows = QUERIES["op9_spotsigs"](spark, SMALL)
    assert rows.count() == 200
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_fingerprint_edges(spark, edge, empty):
    rows = spotsigs.fingerprints(edge).collect()
    assert len(rows) == len(EDGE_ROWS)
    same = {r.fingerprint for r in rows if r.doc_id in (4, 5)}
    assert len(same) == 1                                 # equal texts have equal fingerprints
    unique = [(r[0], r[1] or "") for i, r in enumerate(EDGE_ROWS) if r[0] is not None and i != 4 and r[0] != 3]
    check_fingerprints(spotsigs.fingerprints(spark.createDataFrame(unique, "doc_id long, text string")).collect(), unique)
    assert spotsigs.fingerprints(empty).count() == 0
    one = spotsigs.fingerprints(spark.createDataFrame([(1, SENTENCE)], "doc_id long, text string")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("cuts", [[], [5], [1, 2, 3], list(range(0, 100, 7))])
def test_ranges_of_ids(spark, cuts):
    from pyspark.sql import functions as F
    got = {r.id: r.n for r in spark.range(-3, 110).select("id", spotsigs.not_above(cuts, F.col("id")).alias("n")).collect()}
    assert got == {x: sum(c <= x for c in cuts) for x in range(-3, 110)}


def test_pruned_jaccard(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 4, 5]), ([1], [1, 2, 3, 4, 5, 6])], "a array<int>, b array<int>")
    from pyspark.sql import functions as F
    full = [r[0] for r in df.select(spotsigs.pruned_jaccard(F.col("a"), F.col("b"))).collect()]
    assert full == [pytest.approx(0.8), pytest.approx(1 / 6)]
    assert [r[0] for r in df.select(spotsigs.pruned_jaccard(F.col("a"), F.col("b"), 0.8)).collect()] == [pytest.approx(0.8), 0.0]


# -- operator 4 -------------------------------------------------------------------
def brute_nearest(rows, every=100, k=10):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i % every == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out[i] = d
    return out


def recall(df, want):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hit = total = 0
    for q, best in want.items():
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [(m[1], m[2]) for m in mine] == sorted((m[1], m[2]) for m in mine)
        hit += len({m[2] for m in mine} & {j for _, j in best})
        total += len(best)
    assert set(got) == {q for q, best in want.items() if best}
    return hit / total


def test_search_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert recall(QUERIES["op4_hnsw_search"](spark, SMALL), brute_nearest(rows)) >= 0.95


@pytest.mark.parametrize("shard", [100, 8192])
def test_search_shards_and_ties(spark, shard):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist()) for i in range(40)]   # a vector that many rows share
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = hnsw.build_index(df, shard=shard, keep_ids=11)
    assert recall(hnsw.search(index, df.where("vec_id % 50 = 0")), brute_nearest(rows, 50)) >= 0.98
    top = [r.vec_id for r in hnsw.search(index, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert top == list(range(1000, 1010))


def placed(name):
    """Vectors that are hard for single precision: far from zero, very large or small, at several scales."""
    u = np.random.default_rng(4).standard_normal((1500, 24))
    spread = 10.0 ** np.random.default_rng(5).uniform(-8, 8, (1500, 1))
    far = u.copy()
    far[:300] += 1e9
    out = u.copy()
    out[:5] *= 1e20
    return {"offset": 1000 + 0.1 * u, "1e20": u * 1e20, "1e200": u * 1e200, "1e-200": u * 1e-200, "offset 1e6": 1e6 + u, "outliers": out,
            "two clusters": far, "small cluster": np.concatenate([u[:700], u[700:] * 1e-6 + 5]), "spread": u * spread}[name]


@pytest.mark.parametrize("name", ["offset", "1e20", "1e200", "1e-200", "offset 1e6", "outliers", "two clusters", "small cluster", "spread"])
def test_search_at_any_offset_and_scale(spark, name):
    x = placed(name)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.search(hnsw.build_index(df, shard=800), df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 20):
        d = hnsw.lengths(x - x[q])
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        mine = sorted(got[q])
        assert [m[2] for m in mine] == pytest.approx([d[m[1]] for m in mine], rel=1e-12)
        hit += len({m[1] for m in mine} & set(best.tolist()))
    assert hit / (75 * 10) >= 0.95


def test_lengths_do_not_overflow():
    d = np.array([[3e200, 4e200], [3e-200, 4e-200], [3.0, 4.0], [0.0, 0.0], [5e-324, 0.0]])
    assert hnsw.lengths(d) == pytest.approx([5e200, 5e-200, 5.0, 0.0, 5e-324])


def test_shards_grow_with_the_table():
    assert [hnsw.shard_rows(n) for n in (0, 10_000, 320_000, 1_000_000, 10_000_000)] == [5_000, 5_000, 5_000, 15_625, 65_536]


def test_search_edges(spark):
    bad = [(100, None), (200, []), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (None, [1.0, 2.0])]
    rows = bad + [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0]), (700, [5.0, 5.0, 5.0])]
    schema = "vec_id long, embedding array<float>, shard string, query int, place string"
    df = spark.createDataFrame([(*r, "s", 1, "p") for r in rows], schema)
    got = [tuple(r) for r in hnsw.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, pytest.approx(10 ** 0.5))]
    assert hnsw.nearest(spark.createDataFrame([], schema)).count() == 0


def test_join_query_equals_its_oracle(spark):
    from fareflow.llm.queries import ORACLES
    from fareflow.plans.oracle_check import digest, duck
    df = QUERIES["op5_ngram_jaccard_join"](spark, SMALL)
    cur = duck(SMALL).execute(ORACLES["op5_ngram_jaccard_join"])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns) and digest(df.columns, df.collect()) == digest(columns, cur.fetchall())
