"""Operator 12: prefix trie of conversations, by ternary search trees per range shard.

1. ``sequences``: a turn becomes a code of fixed width (128 bits of the digest
   of role and text, and the length of the text), so later steps move codes
   instead of texts; a conversation is the list of its codes.
2. ``trie`` deals the conversations into ranges of (sequence, conv_id), so a
   sequence that a third of all conversations share is spread over shards.
3. Each shard numbers its codes in order (its dictionary) and inserts its
   different sequences into a ternary search tree, the median first, then the
   medians of both halves, so the siblings of a node form a balanced tree.
   Trees are flat arrays; a child comes after its parent, so one pass from
   the last node to the first accumulates members, leaves and savings.
4. A node lies in several shards only if it is a prefix of the first or the
   last sequence of a shard.  These paths (two a shard, with what hangs from
   their nodes summed up) are merged in shard order by one streaming pass that
   holds a single path; all other nodes are complete in their shard.
5. Nodes whose parent is on such a path learn its smallest member by a join.

``ends_sha256`` is a digest of all ids that end at a node, in order, which no
two tasks can share; ids travel as joined strings of bounded size, and the
pass holds one of them at a time.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, scratch_table

#: Bytes of a turn's code: of its digest, and of its length in code points.
DIGEST, LENGTH = 16, 4
CODE = DIGEST + LENGTH
#: Conversation ids joined into one string, and rows of an output batch.
IDS, ROWS = 20_000, 20_000
NONE = hashlib.sha256().hexdigest()
EMPTY_KEY = hashlib.blake2b(digest_size=16)

INNER, PATH, ENDS = 0, 1, 2
NODE = [("conv_id", "long"), ("depth", "long"), ("parent_conv_id", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"),
        ("saved_tokens", "long"), ("ends_sha256", "string"), ("key", "string"), ("parent_key", "string")]
SHARD = [*NODE, ("kind", "int"), ("shard", "int"), ("nth", "long"), ("path", "binary"), ("sums", "array<long>"), ("ids", "string")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def sequences(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv_id, codes) of every conversation: hexadecimal codes of its turns
    in order of turn (null first; equal turns by code).

    Null role or text counts as empty; rows without a conversation id belong
    to none and are left out; repeated rows are turns of their own; further
    columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    code = F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.lower(F.hex(F.length("text"))), 2 * LENGTH, "0"))
    return (turns.select("conv_id", "turn", code.alias("code")).groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "code"))).alias("turns"))
            .select("conv_id", F.col("turns.code").alias("codes")))


class Tree:
    """Ternary search tree in flat arrays; node 0 is the textless root."""

    def __init__(self):
        self.symbol, self.low, self.equal, self.high, self.up, self.depth = ([x] for x in (-1, 0, 0, 0, -1, 0))

    def _add(self, symbol: int, up: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, 0), (self.equal, 0), (self.high, 0), (self.up, up), (self.depth, self.depth[up] + 1)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, sequence: list[int]) -> int:
        """The node of ``sequence``, with new nodes where it leaves the tree."""
        node = 0
        for s in sequence:
            at, slot, holder = self.equal[node], self.equal, node
            while at and self.symbol[at] != s:
                slot, holder = (self.low if s < self.symbol[at] else self.high), at
                at = slot[at]
            if not at:
                at = slot[holder] = self._add(s, node)
            node = at
        return node


def medians(n: int) -> Iterator[int]:
    """0..n-1, the median first, then the medians of both halves."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(mid + 1, hi), (lo, mid)]


def joined(ids: array) -> str:
    return ",".join(map(str, ids))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = 0
    while n < min(len(a), len(b)) and a[n: n + CODE] == b[n: n + CODE]:
        n += CODE
    return n // CODE


def keys_of(path: bytes) -> list[str]:
    """Keys of the nodes on a path, from the root."""
    key, out = EMPTY_KEY.copy(), [EMPTY_KEY.hexdigest()]
    for k in range(0, len(path), CODE):
        key.update(path[k: k + CODE])
        out.append(key.hexdigest())
    return out


def shard_rows(paths: list[bytes], ids: list[array], shard: int) -> Iterator[dict]:
    """Rows of a shard: complete inner nodes, its first and last path with
    the sums of what hangs from them, and the ids that end on these paths.
    ``paths`` are different and sorted."""
    codes = sorted({p[k: k + CODE] for p in paths for k in range(0, len(p), CODE)})
    number = {c: i for i, c in enumerate(codes)}
    tree, n_paths = Tree(), len(paths)
    end = [0] * n_paths
    for i in medians(n_paths):
        p = paths[i]
        end[i] = tree.insert([number[p[k: k + CODE]] for k in range(0, len(p), CODE)])
    n = len(tree.symbol)
    chars = [0] + [int.from_bytes(codes[s][DIGEST:], "big") for s in tree.symbol[1:]]
    members, first, ending = [0] * n, [None] * n, {}
    for i, node in enumerate(end):
        members[node], first[node], ending[node] = len(ids[i]), ids[i][0], ids[i]
    border: dict[int, str] = {}
    lines = []
    for p, node in ((paths[0], end[0]), (paths[-1], end[-1])):
        line = [node]
        while line[-1]:
            line.append(tree.up[line[-1]])
        lines.append(line[::-1])
        border.update(zip(line[::-1], keys_of(p)))
    read, kept, leaves, children = [0] * n, [0] * n, [0] * n, [0] * n      # code points in members' turns, in nodes' turns
    for node in range(n - 1, 0, -1):
        up = tree.up[node]
        members[up] += members[node]
        first[up] = first[node] if first[up] is None else min(first[up], first[node])
        if node not in border:
            read[node] += members[node] * chars[node]
            kept[node] += chars[node]
            leaves[node] = leaves[node] if children[node] else 1
            for column, value in ((read, read[node]), (kept, kept[node]), (leaves, leaves[node]), (children, 1)):
                column[up] += value
    for node in range(1, n):
        if node not in border:
            up = tree.up[node]
            hangs = up in border
            yield {"kind": INNER, "conv_id": first[node], "depth": tree.depth[node], "parent_conv_id": None if hangs else first[up],
                   "parent_key": border[up] if hangs else None, "n_convs": members[node], "n_children": children[node], "n_leaves": leaves[node],
                   "saved_tokens": read[node] - kept[node],
                   "ends_sha256": hashlib.sha256(joined(ending[node]).encode()).hexdigest() if node in ending else NONE}
    nth, skip = 0, 0
    for line, path in zip(lines[: 1 + (n_paths > 1)], (paths[0], paths[-1])):
        own = line[skip:]
        sums = [x for column in (members, first, read, kept, leaves, children) for x in map(column.__getitem__, own)]
        yield {"kind": PATH, "shard": shard, "nth": nth, "path": path, "depth": skip, "sums": sums}
        nth += 1
        for node in own:
            for k in range(0, len(ending.get(node, ())), IDS):
                yield {"kind": ENDS, "shard": shard, "nth": nth, "depth": tree.depth[node], "ids": joined(ending[node][k: k + IDS])}
                nth += 1
        skip = common(paths[0], paths[-1]) + 1


class Open:
    """A node of the path that the merging pass holds."""

    def __init__(self, code: bytes, above: "Open | None"):
        self.code, self.key = code, EMPTY_KEY.copy() if above is None else above.key.copy()
        self.key.update(code)
        self.chars = int.from_bytes(code[DIGEST:], "big")
        self.members = self.read = self.kept = self.leaves = self.children = 0
        self.first, self.ends, self.any = None, hashlib.sha256(), False


def merged_rows(rows: Iterator[dict]) -> Iterator[dict]:
    """Nodes of the shards' first and last paths, from rows in shard order."""
    stack: list[Open] = []

    def close(depth: int) -> Iterator[dict]:
        while len(stack) > depth:
            node = stack.pop()
            up = stack[-1] if stack else None
            node.read += node.members * node.chars
            node.kept += node.chars
            node.leaves = node.leaves if node.children else 1
            yield {"conv_id": node.first, "depth": len(stack), "n_convs": node.members, "n_children": node.children, "n_leaves": node.leaves,
                   "saved_tokens": node.read - node.kept, "ends_sha256": node.ends.hexdigest(), "key": node.key.hexdigest(),
                   "parent_key": up and up.key.hexdigest()}
            if up:
                up.read, up.kept, up.leaves, up.children = up.read + node.read, up.kept + node.kept, up.leaves + node.leaves, up.children + 1

    for r in rows:
        if r["kind"] == ENDS:
            node = stack[r["depth"]]
            node.ends.update((b"," if node.any else b"") + r["ids"].encode())
            node.any = True
            continue
        path = r["path"]
        if not stack:
            stack.append(Open(b"", None))
        same = common(b"".join(x.code for x in stack), path)
        yield from close(same + 1)
        for k in range(same * CODE, len(path), CODE):
            stack.append(Open(path[k: k + CODE], stack[-1]))
        own, sums = stack[r["depth"]:], r["sums"]
        m = len(own)
        for i, node in enumerate(own):
            members, first, read, kept, leaves, children = sums[i::m]
            node.members, node.read, node.kept = node.members + members, node.read + read, node.kept + kept
            node.leaves, node.children = node.leaves + leaves, node.children + children
            node.first = first if node.first is None else min(node.first, first)
    yield from close(0)


def _batches(rows: Iterator[dict], fields: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields)


def trie(conversations: DataFrame, *, shards: int | None = None) -> DataFrame:
    """Nodes of the prefix trie of ``conversations`` (conv_id, codes; as
    ``sequences`` gives them): ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.

    A conversation without turns is a member of the root.  Without
    conversations there is no node, not even a root.  ``shards`` is the number of
    ranges (the session's shuffle partitions, unless given).
    """
    spark = conversations.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = scratch_table(conversations.select("conv_id", F.unhex(F.array_join("codes", "")).alias("path")))
    dealt = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from fareflow.llm.conversation_trie import SHARD, _batches, shard_rows

        paths, ids = [], []
        for b in batches:
            for conv_id, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not paths or paths[-1] != path:
                    paths.append(path)
                    ids.append(array("q"))
                ids[-1].append(conv_id)
        if paths:
            yield from _batches(shard_rows(paths, ids, TaskContext.get().partitionId()), SHARD)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.conversation_trie import NODE, _batches, merged_rows

        yield from _batches(merged_rows(r for b in batches for k in range(len(b)) for r in b.slice(k, 1).to_pylist()), NODE)

    nodes = scratch_table(map_batches(dealt, build, _schema(SHARD)))
    inner, names = nodes.where(F.col("kind") == INNER), [name for name, _ in NODE]
    border = nodes.where(F.col("kind") != INNER).select("shard", "nth", "kind", "depth", "path", "sums", "ids")
    merged = scratch_table(map_batches(border.repartition(1).sortWithinPartitions("shard", "nth"), merge, _schema(NODE)))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    open_ended = inner.where(F.col("parent_key").isNotNull()).select(*names).unionByName(merged)
    known = open_ended.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("found"))
    out = [name for name in names if name not in ("key", "parent_key")]
    return inner.where(F.col("parent_key").isNull()).select(*out).unionByName(known.select(*out))
