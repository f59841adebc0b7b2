"""Operator 4: nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt to shards by their hash.  Each shard's graph is built in one
task and kept as flat neighbour arrays (one row per vector: its links on each
layer, padded with -1).  Every query visits every shard's graph: blocks of
queries are sent to each shard, where a task loads the graph and streams them
through.  The shards' results are merged by exact distance, then id.

Shards grow with the table up to ``LARGEST`` rows, so that there are about
``SHARDS`` of them and a query's work is that many searches at any size up to
there (beyond, work grows with queries times shards); the search beam
grows with the root of a shard, which keeps the recall.

A graph sees its vectors moved by their median and scaled to their spread in
double precision, so it works at any offset and scale.  Shards whose vectors or
neighbours lie over several orders of magnitude compare differences in double
precision.

Equal vectors are one node that carries its smallest ids, so a vector that a
third of all rows share is one node too.

Building and searching work on many vectors at once: in each step, all
searches of a block expand their nearest open candidates together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, scratch_table, ship

#: Rows of a shard, at least and at most; shards of tables between.
SHARD, LARGEST, SHARDS = 5_000, 65_536, 64
#: Links per node (twice as many on the ground layer), beam widths while building and searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 96, 160
EXPAND = 4                                    # candidates expanded at a time
BLOCK = 256                                   # vectors inserted or searched at a time


def _power(value: float) -> float:
    """The power of two at or below a positive value; 1 for 0."""
    return float(2.0 ** max(-1022, np.frexp(value)[1] - 1)) if value > 0 else 1.0


#: Largest size, in units of the median, up to which a shard is compared in single precision.
WIDE = 32
#: A vector is crowded if its tenth neighbour is nearer than this share of its own size.
CROWDED = 0.01


def _crowded(x: np.ndarray, size: np.ndarray) -> bool:
    """Whether one of a hundred of some vectors (128 at most, evenly taken) is
    crowded, so that squares in single precision would not tell its neighbours."""
    some = np.arange(0, len(x), -(-len(x) // 128))
    if len(x) < 12:
        return False
    near = [np.partition(np.einsum("nd,nd->n", x - x[i], x - x[i]), 10)[10] for i in some]
    return float(np.mean(np.sqrt(near) < CROWDED * size[some])) > 0.01


class Graph:
    """Vectors, levels and flat neighbour arrays of one shard."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        x = np.ascontiguousarray(vectors, np.float64)
        n = len(x)
        self.top = _power(np.abs(x).max(initial=0.0))
        x = x / self.top
        self.centre = np.median(x, 0) if n else 0.0
        x = x - self.centre
        size = np.sqrt(np.einsum("nd,nd->n", x, x))
        self.unit = _power(float(np.median(size[size > 0])) if (size > 0).any() else 0.0)
        self.wide = bool(n) and (float(size.max()) > WIDE * self.unit or _crowded(x, size))
        self.x = np.ascontiguousarray(x / self.unit, np.float64 if self.wide else np.float32)
        self.norm = np.zeros(n) if self.wide else np.einsum("nd,nd->n", self.x, self.x)
        self.links = links
        draw = np.random.default_rng(n).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(np.int64), 8)
        self.layers: list[np.ndarray] = []                # neighbour arrays, ground layer first
        self.entry = 0

    def moved(self, q: np.ndarray) -> np.ndarray:
        """Vectors as the graph sees its own."""
        return np.ascontiguousarray((np.asarray(q, np.float64) / self.top - self.centre) / self.unit, self.x.dtype)

    # -- search -----------------------------------------------------------------
    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances (up to each query's own norm, unless wide) of ``q[i]`` to ``ids[i]``."""
        if self.wide:
            d = self.x[ids] - q[:, None, :]
            return np.einsum("nwd,nwd->nw", d, d)
        return self.norm[ids] - 2 * np.matmul(self.x[ids], q[:, :, None])[:, :, 0]

    def beam(self, q: np.ndarray, start: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the ``width`` nearest found from ``start`` (queries, entries); -1: none."""
        nbrs, n = self.layers[layer], len(q)
        rows = np.arange(n)
        seen = np.zeros((n, len(self.x) + 1), bool)       # the last column takes the padding
        seen[:, -1] = True
        ids = np.full((n, width), -1, np.int64)
        dist = np.full((n, width), np.inf, self.x.dtype)
        start = start[:, :width]
        fresh = np.zeros(start.shape, bool)
        for j in range(start.shape[1]):
            fresh[:, j] = ~seen[rows, start[:, j]]
            seen[rows, start[:, j]] = True
        ids[:, :start.shape[1]] = np.where(fresh, start, -1)
        dist[:, :start.shape[1]] = np.where(fresh, self.distances(q, start), np.inf)
        open_ = np.isfinite(dist)
        live = rows
        while True:
            todo = np.where(open_[live], dist[live], np.inf)
            k = min(EXPAND, width)
            best = np.argpartition(todo, k - 1, 1)[:, :k] if k < width else np.tile(np.arange(width), (len(live), 1))
            good = np.isfinite(np.take_along_axis(todo, best, 1))
            busy = good.any(1)
            if not busy.any():
                return ids, dist
            live, best, good = live[busy], best[busy], good[busy]
            at = np.take_along_axis(ids[live], best, 1)
            open_[live[:, None], best] &= ~good
            near = np.where(good[:, :, None], nbrs[np.maximum(at, 0)], -1)
            for j in range(near.shape[1]):                # a node that two candidates share counts once
                near[:, j] = np.where(seen[live[:, None], near[:, j]], -1, near[:, j])
                seen[live[:, None], near[:, j]] = True
            near = near.reshape(len(live), -1)
            d = np.where(near >= 0, self.distances(q[live], np.maximum(near, 0)), np.inf)
            all_ids = np.concatenate([ids[live], near], 1)
            all_d = np.concatenate([dist[live], d], 1)
            all_open = np.concatenate([open_[live], near >= 0], 1)
            keep = np.argpartition(all_d, width - 1, 1)[:, :width]
            ids[live] = np.take_along_axis(all_ids, keep, 1)
            dist[live] = np.take_along_axis(all_d, keep, 1)
            open_[live] = np.take_along_axis(all_open, keep, 1) & np.isfinite(dist[live])

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Entries on layer ``to`` - the nearest nodes found on the layers above."""
        at = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, to, -1):
            ids, dist = self.beam(q, at, 4, layer)
            at = np.take_along_axis(ids, dist.argmin(1)[:, None], 1)
        return at

    def search(self, q: np.ndarray, k: int, width: int) -> np.ndarray:
        """Ids (queries, k) of the nearest found, -1 where there are fewer."""
        q = self.moved(q)
        if len(self.x) <= max(width // 2, k):             # so few: all of them
            d = self.distances(q, np.tile(np.arange(len(self.x)), (len(q), 1)))
            ids = np.argsort(d, 1, kind="stable")[:, :k]
            return np.pad(ids, ((0, 0), (0, k - ids.shape[1])), constant_values=-1)
        ids, dist = self.beam(q, self.descend(q, 0), max(width, k), 0)
        order = np.argsort(dist, 1, kind="stable")[:, :k]
        return np.where(np.isfinite(np.take_along_axis(dist, order, 1)), np.take_along_axis(ids, order, 1), -1)

    # -- building ---------------------------------------------------------------
    def diverse(self, of: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
        """Up to ``k`` neighbours per row: candidates by distance, each kept if
        it is nearer to the row's node than to every neighbour kept so far;
        free places are filled with the nearest of the rest."""
        order = np.argsort(dist, 1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        n, width = ids.shape
        real = np.isfinite(dist)
        own = dist + self.norm[of][:, None]               # true squared distances
        x = self.x[np.maximum(ids, 0)]
        kept = np.zeros((n, width), bool)
        shadow = np.full((n, width), np.inf, self.x.dtype)  # distance to the nearest kept neighbour
        count = np.zeros(n, np.int64)
        nrm = self.norm[np.maximum(ids, 0)]
        for j in range(width):
            take = real[:, j] & (count < k) & (own[:, j] < shadow[:, j])
            if not take.any():
                continue
            kept[take, j] = True
            count += take
            if j + 1 < width:
                t = np.flatnonzero(take)
                if self.wide:
                    d = x[t, j + 1:] - x[t, j][:, None, :]
                    d = np.einsum("nwd,nwd->nw", d, d)
                else:
                    d = nrm[t, j + 1:] + nrm[t, j][:, None] - 2 * np.matmul(x[t, j + 1:], x[t, j][:, :, None])[:, :, 0]
                shadow[t, j + 1:] = np.minimum(shadow[t, j + 1:], d)
        rank = np.where(kept, 0, np.where(real, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, 1, kind="stable")[:, :k]
        out = np.where(np.take_along_axis(real, order, 1), np.take_along_axis(ids, order, 1), -1)
        return np.pad(out, ((0, 0), (0, k - out.shape[1])), constant_values=-1) if out.shape[1] < k else out

    def _link_back(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the links from the chosen neighbours to the new nodes; full rows keep a diverse choice."""
        nbrs = self.layers[layer]
        cap = nbrs.shape[1]
        to, back = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        real = to >= 0
        to, back = to[real], back[real]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        host, first, n = np.unique(to, return_index=True, return_counts=True)
        slot = np.arange(len(to)) - np.repeat(first, n)
        extra = np.full((len(host), int(n.max())), -1, np.int64)
        extra[np.repeat(np.arange(len(host)), n), slot] = back
        both = np.sort(np.concatenate([nbrs[host], extra], 1), 1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1     # two nodes of a block may have chosen each other
        fits = (both >= 0).sum(1) <= cap
        packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)[:, :cap]
        nbrs[host[fits]] = packed[fits]
        full = np.flatnonzero(~fits)
        for i in range(0, len(full), 2048):
            f = full[i: i + 2048]
            d = np.where(both[f] >= 0, self.distances(self.x[host[f]], np.maximum(both[f], 0)), np.inf)
            nbrs[host[f]] = self.diverse(host[f], both[f], d, cap)

    def build(self, width: int = BUILD_BEAM) -> "Graph":
        n = len(self.x)
        top = int(self.level.max()) if n else 0
        self.layers = [np.full((n + 1, self.links * (2 if layer == 0 else 1)), -1, np.int32) for layer in range(top + 1)]
        if not n:
            return self
        self.entry = int(self.level.argmax())
        rest = np.delete(np.arange(n), self.entry)
        done, size = 0, 1
        while done < len(rest):
            nodes = rest[done: done + size]
            done += len(nodes)
            size = min(BLOCK, max(1, done // 2))
            planned = []
            for layer in range(top, -1, -1):
                mine = nodes[self.level[nodes] >= layer]
                if not len(mine):
                    continue
                q = self.x[mine]
                ids, dist = self.beam(q, self.descend(q, layer), width, layer)
                peers = np.tile(mine, (len(mine), 1))     # nodes of the same block see each other
                pd_ = self.distances(q, peers)
                np.fill_diagonal(pd_, np.inf)
                few = min(len(mine), self.links)
                pick = np.argpartition(pd_, few - 1, 1)[:, :few]
                ids = np.concatenate([ids, np.take_along_axis(peers, pick, 1)], 1)
                dist = np.concatenate([dist, np.take_along_axis(pd_, pick, 1)], 1)
                planned.append((layer, mine, self.diverse(mine, ids, dist, self.links)))
            for layer, mine, chosen in planned:           # linked once all of the block have searched
                self.layers[layer][mine, : self.links] = chosen
                self._link_back(layer, mine, chosen)
        return self


def usable(vector: str):
    """Whether a vector takes part: it holds no null or non-finite component and is not null, empty or zero."""
    v = F.col(vector)
    return F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
                      & F.exists(v, lambda c: c != 0), F.lit(False))


def shard_rows(rows: int) -> int:
    """Rows of a shard of a table of ``rows`` vectors."""
    return min(LARGEST, max(SHARD, -(-rows // SHARDS)))


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None,
                keep_ids: int = 11) -> DataFrame:
    """The graphs as a table, one row per distinct vector: ``dim``, ``shard``,
    ``place`` in its shard, ``ids`` (the ``keep_ids`` smallest), ``vector``,
    ``entry`` (of the shard) and ``links`` (flat neighbour places, layer by
    layer, with -1 for none).  Shards hold about ``shard`` rows (``shard_rows``
    of the table, unless given)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(usable("vector") & F.col("id").isNotNull()).distinct()
    first = Window.partitionBy("vector").orderBy("id")    # tasks drop all but the first ids of a vector before the shuffle
    distinct = scratch_table(rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= keep_ids)
                             .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = distinct.count()
    shards = max(1, -(-n // (shard or shard_rows(n))))
    dealt = distinct.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from fareflow.llm.hnsw import Graph

        pdf = pdf.sort_values("ids", key=lambda c: c.str[0]).reset_index(drop=True)
        g = Graph(np.stack(pdf["vector"].to_numpy())).build()
        flat = np.concatenate([layer[:-1] for layer in g.layers], 1)
        return pdf.assign(place=np.arange(len(pdf), dtype=np.int32), entry=np.int32(g.entry), links=list(flat))

    ship(vectors.sparkSession)
    return dealt.groupBy("dim", "shard").applyInPandas(
        build, "vector array<double>, ids array<long>, dim int, shard int, place int, entry int, links array<int>")


def search(index: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
           width: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` nearest rows of the index per query, without the query's own id:
    query_id, rank (from 1), ``id_col``, score (Euclidean distance in double
    precision), nearest first, ties to the smaller id.  ``width`` is the
    beam of a graph of 8,192 vectors."""
    shards = index.select("shard").distinct().count()
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    q = scratch_table(q.where(usable("vector") & F.col("id").isNotNull()).distinct())
    blocks = max(1, -(-q.count() // BLOCK))
    packed = (q.groupBy(F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
              .agg(F.collect_list(F.struct("id", "vector")).alias("rows")))
    sent = packed.select("dim", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))).alias("shard"),
                         F.lit(True).alias("query"), F.lit(0).alias("place"), F.col("rows.id").alias("ids"),
                         F.flatten("rows.vector").alias("vector"), F.lit(0).alias("entry"), F.array().cast("array<int>").alias("links"))
    rows = index.select("dim", "shard", F.lit(False).alias("query"), "place", "ids", "vector", "entry", "links").unionByName(sent)
    rows = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "query", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.hnsw import search_stream

        return search_stream(batches, k, width)

    found = map_batches(rows, run, "query_id long, score double, ids array<long>")
    each = found.select("query_id", "score", F.explode("ids").alias(id_col)).where(F.col(id_col) != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("score", id_col)
    return (each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score"))


def lengths(d: np.ndarray) -> np.ndarray:
    """Euclidean lengths in double precision, also where squares overflow or vanish."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((d * d).sum(1))
        most = np.abs(d).max(1, initial=0.0)
        odd = np.flatnonzero((most > 0) & ((most > 1e150) | (most < 1e-150)))
        if len(odd):
            part = d[odd] / most[odd, None]
            out[odd] = most[odd] * np.sqrt((part * part).sum(1))
    return out


def search_stream(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """Reads a shard's index rows, then its queries, block by block."""
    key, parts, graph, ids, exact = None, [], None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        where = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
        cuts = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1, [len(where)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = b.slice(lo, hi - lo)
            if key != tuple(where[lo][:2]):
                key, parts, graph = tuple(where[lo][:2]), [], None
            if not where[lo][2]:
                parts.append(part)
                continue
            if graph is None:
                if not parts:
                    continue                              # no vectors of this length here
                graph, ids, exact = _assemble(parts)
                parts = []
            dim = exact.shape[1]
            q = part.column("vector").flatten().to_numpy().reshape(-1, dim)
            own = part.column("ids").flatten().to_numpy()
            for i in range(0, len(q), BLOCK):
                block = q[i: i + BLOCK].astype(np.float64)
                got = graph.search(block, k + 1, round(width * max(1.0, (len(exact) / 8192) ** 0.5)))
                r, c = np.nonzero(got >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[i + r], pa.int64()), pa.array(lengths(exact[got[r, c]] - block[r]), pa.float64()),
                     pa.array([ids[j] for j in got[r, c]], pa.list_(pa.int64()))], ["query_id", "score", "ids"])


def _assemble(parts: list[pa.RecordBatch]) -> tuple[Graph, list[list[int]], np.ndarray]:
    """The graph, the ids of its nodes and the vectors in double precision, from index rows in order of place."""
    t = pa.Table.from_batches(parts)
    n = t.num_rows
    exact = t.column("vector").combine_chunks().flatten().to_numpy().reshape(n, -1).astype(np.float64)
    flat = t.column("links").combine_chunks().flatten().to_numpy().reshape(n, -1)
    g = Graph(exact)
    g.entry = t.column("entry")[0].as_py()
    pad = np.full((1, flat.shape[1]), -1, flat.dtype)
    flat = np.concatenate([flat, pad])
    ends = [2 * g.links, *range(3 * g.links, flat.shape[1] + 1, g.links)]
    g.layers = [flat[:, lo:hi] for lo, hi in zip([0, *ends[:-1]], ends)]
    return g, t.column("ids").to_pylist(), exact


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` nearest of each vector whose id is divisible by ``every``, among all others.

    Vectors that are null, empty or zero, or hold null or non-finite
    components, take no part, nor do rows with a null id; vectors are compared
    with those of their own length only; rows that repeat count once; equal
    vectors are ties, won by the smaller id; with fewer than ``k`` candidates
    all are given; an empty table gives an empty result; further columns are
    ignored.
    """
    index = scratch_table(build_index(vectors, id_col=id_col, vector_col=vector_col, keep_ids=k + 1))
    return search(index, vectors.where(F.col(id_col) % every == 0), id_col=id_col, vector_col=vector_col, k=k)
