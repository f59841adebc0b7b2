"""Operator 5: Jaccard join of documents on word shingles by a MinHash LSH forest.

1. Texts become sets of five-word shingles; in each of ``TREES`` prefix tries a
   text is the path of its ``LONGEST`` MinHash values.  Equal texts share one
   node (a copy count stands for them).
2. The tries are climbed level by level.  At each level subtrees of one prefix
   meet and are linked to the smallest of them (a group-by over one row a
   subtree), then the prefixes are shortened by a value, until pairs at the
   threshold meet in some trie with the target recall.  No prefix is expanded
   into pairs, and texts that are alone under the shortest prefix drop out at once.
3. Exact verification of all pairs that share a prefix.  Components of the links
   say which subtrees overlap.  If the pairs of a component are no more than those
   of its subtrees together, its texts are compared once, as one; else (texts
   that are a little alike percolate into large components) each subtree is
   compared by itself, a pair in the first trie where it meets.  So work is
   bounded by the pairs that share a prefix.  Blocks are of bounded size, so
   a group of any size is spread over many tasks; they give back link counts and
   labels, not pairs.
4. Components of the verified links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, scratch_table, text_runs, whole_text
from .components import connected
from .words import Words, mix

SHINGLE, THRESHOLD = 5, 0.8
TREES, LONGEST, RECALL = 24, 8, 0.999
#: Size of a verification block: documents, code points.
BLOCK_DOCS, BLOCK_CHARS = 2048, 8_000_000


def recall_of(depth: int, threshold: float, trees: int) -> float:
    """Chance that a pair at the threshold shares a prefix of ``depth`` values in some trie."""
    return 1 - (1 - threshold ** depth) ** trees


def shortest_prefix(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """Where climbing ends: the longest prefix that reaches the target recall."""
    depth = longest
    while depth and recall_of(depth, threshold, trees) < recall:
        depth -= 1
    if not depth:
        raise ValueError("too few tries for this recall")
    return depth


def shingle_hashes(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, flat, and their bounds.  A text of fewer
    words than ``size`` has one shingle of all its words; without words, none."""
    counts = words.counts()
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(counts)), n)
    first = words.bounds[owner] + np.arange(int(bounds[-1])) - bounds[owner]
    length = np.minimum(counts[owner], size)
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            live = j < length
            term = np.where(live, words.hashes[np.minimum(first + j, len(words.hashes) - 1)], np.uint64(0)) if len(first) else out
            out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(live, term, np.uint64(j + 1))
    return mix(out), bounds


def trie_paths(shingles: np.ndarray, bounds: np.ndarray, trees: int, longest: int, shortest: int) -> np.ndarray:
    """(texts, trees, levels) keys of the signature's prefixes, longest first; texts without shingles have zeros."""
    rng = np.random.default_rng(20_05)
    n = len(bounds) - 1
    keys = np.zeros((n, trees, longest - shortest + 1), np.uint64)
    filled = np.flatnonzero(np.diff(bounds))
    if not len(filled):
        return keys
    begins = bounds[filled]
    for t in range(trees):
        key = np.full(len(filled), t + 1, np.uint64)
        for depth in range(1, longest + 1):
            flip, factor = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            least = np.minimum.reduceat(((shingles ^ flip) * (factor | np.uint64(1))) >> np.uint64(24), begins)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            if depth >= shortest:
                keys[filled, t, longest - depth] = key
    return keys


def signatures(docs: DataFrame, id_col: str, text_col: str, *, shingle: int, trees: int, longest: int, shortest: int) -> DataFrame:
    """One row per document: id, md5 of the text, code points, prefix keys by trie, longest first (none for texts without words)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.jaccard_join import shingle_hashes, trie_paths
        from fareflow.llm.words import Words

        for b in batches:
            texts, keys = b.column(2).to_pylist(), []
            for lo, hi in text_runs(texts):
                s, bounds = shingle_hashes(Words(texts[lo:hi]), shingle)
                k = trie_paths(s, bounds, trees, longest, shortest).reshape(hi - lo, -1).view(np.int64)
                keys += [row if full else row[:0] for row, full in zip(k, np.diff(bounds))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "md5", "chars", "keys"])

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("md5"), text.alias("text"))
    return map_batches(rows, run, f"id {kind}, md5 string, chars long, keys array<long>")


def climb(paths: DataFrame, levels: int) -> DataFrame:
    """Links (node, hub) of subtrees that meet: ``paths`` has a row (node,
    tree, path) for each node and trie, ``path`` being its prefix keys, longest
    first.  A subtree is represented by its smallest node; at each level
    those of one prefix are linked to the smallest of them, which goes on with
    a prefix shorter by one value."""
    heads, links = paths, None
    for level in range(levels):
        prefix = F.col("path")[level]
        met = heads.groupBy("tree", prefix.alias("prefix")).agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.min("path").alias("path"))
        joined = (heads.withColumn("prefix", prefix).join(met.where("hub < top").select("tree", "prefix", "hub"), ["tree", "prefix"])
                  .where("node <> hub").select("node", "hub").distinct())
        links = joined if links is None else links.union(joined)
        heads = met.select(F.col("hub").alias("node"), "tree", "path")
    return links


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set (of distinct hashes)."""
    same = left is right
    sets = left if same else left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1 if len(column) else new      # a hash of one set adds nothing
    owner, column = owner[often], column[often]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate([[0], np.diff(column) != 0]))
    wide = max(64, (4 << 20) // max(1, len(sets)))
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + wide, wide))
    for lo, hi in zip(edges[:-1], edges[1:]):
        if lo < hi:
            base = column[lo] - column[lo] % wide
            table = np.zeros((len(sets), min(wide, int(column[hi - 1] - base) + 1)), np.float32)
            table[owner[lo:hi], column[lo:hi] - base] = 1
            out += (table @ table.T) if same else table[: len(left)] @ table[len(left):].T
    return out


def verify(nodes: np.ndarray, copies: np.ndarray, texts: list[str], side: np.ndarray, *, one: bool, shingle: int, threshold: float,
           prefixes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compares all texts of a block (``one``; ``side`` all 0), or all of side 0
    with all of side 1, either of which may be empty; given ``prefixes`` (texts,
    earlier tries), only pairs that share none of them.  Gives (node, label, links): the smallest node it is linked
    with here, directly or through others, and how many documents have a
    text that is linked to its own."""
    if not one and (side == side[0]).all():                                 # a partner that the hash left empty
        return nodes[:0], nodes[:0], np.zeros(0, np.int64)
    order = np.lexsort((nodes, side))
    keep = np.concatenate([[True], np.diff(nodes[order]) != 0])            # rows that repeat a document
    order = order[keep]
    nodes, copies, side, texts = nodes[order], copies[order], side[order], [texts[i] for i in order]
    prefixes = None if prefixes is None else prefixes[order]
    sets: list[np.ndarray] = []
    for lo, hi in text_runs(texts):
        s, bounds = shingle_hashes(Words(texts[lo:hi]), shingle)
        sets += [np.unique(s[bounds[i]: bounds[i + 1]]) for i in range(hi - lo)]
    size = np.array([len(s) for s in sets], np.float32)
    cut = int(np.searchsorted(side, 1))
    left, right = np.arange(cut), np.arange(cut) if one else np.arange(cut, len(nodes))
    a = sets[:cut]
    shared = _shared(a, a if one else sets[cut:])
    union = size[left][:, None] + size[right][None, :] - shared
    near = (shared >= threshold * union - 1e-3) & (shared > 0)
    for t in range(0 if prefixes is None else prefixes.shape[1]):           # compared where they met before
        near &= prefixes[left, t][:, None] != prefixes[right, t][None, :]
    if one:
        np.fill_diagonal(near, False)
    links = np.zeros(len(nodes), np.int64)
    links[left] += near @ copies[right]
    if not one:
        links[right] += near.T @ copies[left]
    label, none = nodes.copy(), np.iinfo(np.int64).max
    while True:
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(near, label[right][None, :], none).min(1, initial=none))
        label[right] = np.minimum(label[right], np.where(near, label[left][:, None], none).min(0, initial=none))
        if (before == label).all():
            return nodes, label, links


def _verify_blocks(rows: DataFrame, *, shingle: int, threshold: float) -> DataFrame:
    """(node, label, links) of every block; ``rows``: part, bi, bj, side, node,
    copies, text, before (keys of earlier tries, if the part is a subtree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.jaccard_join import verify

        def whole_blocks():                               # (part, bi, bj), batches
            held, key = [], None
            for b in batches:
                if not b.num_rows:
                    continue
                keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
                cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    if key is not None and (keys[lo] != key).any():
                        yield key, held
                        held = []
                    key = keys[lo]
                    held.append(b.slice(lo, hi - lo))
            if held:
                yield key, held

        out: list[tuple] = []
        for (_, bi, bj), parts in whole_blocks():
            side, node, copies = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in (3, 4, 5))
            texts = [t for p in parts for t in p.column(6).to_pylist()]
            before = np.concatenate([p.column(7).flatten().to_numpy(zero_copy_only=False) for p in parts]).reshape(len(node), -1)
            out.append(verify(node, copies, texts, side, one=bi == bj, shingle=shingle, threshold=threshold, prefixes=before))
            if len(out) >= 1000 or len(node) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["node", "label", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["node", "label", "links"])

    spread = rows.repartition("part", "bi", "bj").sortWithinPartitions("part", "bi", "bj")
    return map_batches(spread.select("part", "bi", "bj", "side", "node", "copies", "text", "before"), run, "node long, label long, links long")


def parts_to_compare(paths: DataFrame, comp: DataFrame) -> DataFrame:
    """(part, node, before): the groups of nodes whose pairs are compared.

    A component (``comp``: node, root) is one part if it has no more pairs than
    its subtrees together; else every subtree is one, with each node's keys
    in the tries before its own, for a pair is compared in the first trie
    where it meets.  Subtrees of the same nodes as one in an earlier trie
    are left out: all their pairs met there."""
    last = F.element_at("path", -1)
    member = comp.union(comp.select("root", "root").distinct())
    rows = scratch_table(paths.select("node", "tree", last.alias("prefix")).join(member, "node"))
    square = F.col("size").cast("double") * F.col("size")
    trees = (rows.groupBy("root", "tree", "prefix")
             .agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who")).where("size > 1"))
    trees = scratch_table(trees.groupBy("root", "size", "who").agg(F.min(F.struct("tree", "prefix")).alias("first")))
    cost = trees.groupBy("root").agg(F.sum(square).alias("apart"))
    whole = member.groupBy("root").agg(F.count(F.lit(1)).alias("size")).join(cost, "root").select("root", (square <= F.col("apart")).alias("whole"))
    whole = scratch_table(whole)
    flagged = scratch_table(member.join(whole, "root"))   # the only join of nodes on their component: one row a node
    none = F.array().cast("array<long>")
    one = flagged.where("whole").select(F.col("root").alias("part"), "node", none.alias("before"))
    chosen = trees.join(whole.where("not whole").select("root"), "root", "left_semi")
    chosen = scratch_table(chosen.select("first.tree", "first.prefix", (F.lit(-1) - F.monotonically_increasing_id()).alias("part")))
    apart = rows.join(flagged.where("not whole").select("node"), "node", "left_semi")
    keys = apart.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("tree", "prefix"))).alias("keys"))
    # a trie in which a node is alone is no meeting: its key there is the node's own
    before = F.transform(F.sequence(F.lit(0), F.col("tree") - 1), lambda t: F.coalesce(F.try_element_at("keys", t), F.xxhash64("node", t)))
    apart = (apart.select("node", "tree", "prefix").join(chosen, ["tree", "prefix"]).join(keys, "node")
             .select("part", "node", F.when(F.col("tree") == 0, none).otherwise(before).alias("before")))
    return one.union(apart)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL,
                    block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: id, ``class_id``, ``n_links``, ``text_md5``, ``is_first``.

    Documents are linked if their texts are equal or the Jaccard value of
    their shingle sets is at least ``threshold``; classes are the components
    of the links, named by their smallest id; ``n_links`` counts the documents
    a document is linked to; ``is_first`` marks the rows of one document of
    each class (the smallest id, nulls last; among equal ids the smallest md5).

    Null texts count as empty.  Texts without words have no shingles and are
    linked to equal texts only.  Rows that repeat count as copies of each
    other.  A null id is nobody's name: a class of null ids only has a null
    name.  An empty table gives an empty result; further columns are ignored.
    """
    shortest = shortest_prefix(threshold, trees, LONGEST, recall)
    levels = LONGEST - shortest + 1
    rows = scratch_table(signatures(docs, id_col, text_col, shingle=shingle, trees=trees, longest=LONGEST, shortest=shortest))
    nodes = scratch_table(rows.groupBy("md5").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
                                                  F.max("chars").alias("chars"), F.first("keys").alias("keys"))
                          .withColumn("node", F.monotonically_increasing_id()))
    tree = nodes.where(F.size("keys") > 0).select("node", "keys", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    paths = tree.select("node", "tree", F.slice("keys", F.col("tree") * levels + 1, levels).alias("path")).withColumn("end", F.element_at("path", -1))
    # alone under the shortest prefix: never met
    shared = paths.groupBy("end").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("end")
    paths = scratch_table(paths.join(shared, "end").drop("end"))
    comp = scratch_table(connected(climb(paths, levels), "node", "hub").select("node", "root"))
    part = parts_to_compare(paths, comp)
    member = scratch_table(part.join(nodes.drop("keys"), "node"))
    size = member.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("chars") / block_chars))
                                      .cast("int").alias("blocks"))
    # the texts of members only: one document stands for a node
    text = whole_text(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("md5"), text.alias("text"))
    one_each = scratch_table(member.select("node", "md5", "first_id").distinct())
    # one plan at every size: the texts are dealt by their hash, however few the members are
    found = texts.join(one_each.hint("merge"), "md5").where(F.col("id").eqNullSafe(F.col("first_id"))).select("node", "text")
    found = member.select("part", "node", "copies", "before").join(size, "part").join(found.hint("merge"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    blocks = (found.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("part", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
                      (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "copies", "text", "before"))
    checked = scratch_table(_verify_blocks(blocks, shingle=shingle, threshold=threshold))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
    # a node that was in several blocks may have several labels: join them up
    wide = checked.join(links.where("n > 1").select("node"), "node", "left_semi")
    merged = connected(wide.select("node", "label"), "node", "label")
    final = (links.join(merged, "node", "left")
             .select("node", "links", F.when(F.col("n") > 1, F.coalesce("root", "node")).otherwise(F.col("label")).alias("class")))
    named = nodes.drop("keys", "chars").join(final, "node", "left").select(
        "md5", "first_id", F.coalesce("class", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = scratch_table(named)
    heads = named.groupBy("class").agg(F.min("first_id").alias("class_id"),
                                       F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "md5")).alias("head"))
    named = named.join(heads, "class").select("md5", "class_id", "n_links", "head")
    return rows.select("id", "md5").join(named, "md5").select(
        F.col("id").alias(id_col), "class_id", "n_links", F.col("md5").alias("text_md5"),
        ((F.col("head.md5") == F.col("md5")) & F.col("head.first_id").eqNullSafe(F.col("id"))).alias("is_first"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of near duplicates (see ``near_duplicates``), with all columns of ``docs``."""
    found = scratch_table(near_duplicates(docs, id_col=id_col, text_col=text_col, **options))
    # the caller's columns travel as one, so none of them can clash with the keys
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.md5(whole_text(text_col)).alias("md5"))
    key = found.select(F.col(id_col).alias("one"), F.col("text_md5").alias("two"), "is_first")
    others = key.where(~F.col("is_first")).distinct().drop("is_first")
    repeated = key.where("is_first").groupBy("one", "two").count().where("count > 1").drop("count")

    same = F.col("id").eqNullSafe(F.col("one")) & (F.col("md5") == F.col("two"))
    left = marked.join(others.hint("merge"), same, "left_anti")           # one plan at every size
    if not repeated.isEmpty():
        once = left.join(repeated, same, "left_anti")
        twice = left.join(repeated, same, "left_semi").groupBy("id", "md5").agg(F.first("row").alias("row"))
        left = once.select("row").unionByName(twice.select("row"))
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
