"""Nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors of equal direction become one, which keeps its smallest ids (as many as an
answer can need); they are dealt to shards by the hash of the direction. Those of a shard
that single precision does not tell apart share a node. A shard's graph is built by insertion: a batch of nodes, never more than are in the graph, walks down the
layers and searches the lowest ones with a beam; each node links to a diverse choice of
what it found, and those link back; two more links a node make a tree of all nodes, so that
a crowd of near-equal vectors stays reachable. The graph is one row of flat arrays: neighbours, layer
by layer, with a fixed number of places a node. Queries are sent to the shards, where many
walk together; a shard's graph is read once for each of its blocks of queries. All vectors
of a walk's last beam are scored anew in double precision, and the shards' answers are merged.

Defined results: vectors that are null, zero, empty, of another length than the most common
one (of two as common, the shorter), or with null or non-finite components take no part;
equal scores go to the smaller id, as do vectors that differ by a positive factor only;
repeated rows of one id are one candidate, of different vectors under one id that is asked
for the one that sorts first asks; fewer candidates than asked give
fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import durable, give_back

#: Nodes of a shard, and queries that one task asks it.
SHARD_ROWS = 65_536
QUERY_BLOCK = 16_384
LINKS = 24
#: Widths of the beams of a search and of an insertion, and nodes that a walk opens at once.
BREADTH, BUILD_BREADTH, OPENED = 160, 96, 8
#: Walks that run together; with the nodes of a shard it bounds a task's memory.
TOGETHER = 512
#: Places of a node's first child and next sibling in the tree.
TREE = 2
NONE = -3.0


def direction(vectors: np.ndarray) -> np.ndarray:
    """Vectors by their largest absolute component; those that differ by a positive factor become equal."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True) + 0.0


def unit(vectors: np.ndarray) -> np.ndarray:
    v = direction(vectors.astype(np.float64))  # no overflow in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosines of a direction and rows of directions, in double precision."""
    return (many * one).sum(axis=1) / np.sqrt((one * one).sum() * (many * many).sum(axis=1))


def diverse(ids: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """(rows, most): of each row's candidates, from near to far, those nearer to the row's node than to any
    chosen one, then the nearest of the rest; -1 where there are fewer. ids is -1 behind the last candidate."""
    rows, width = ids.shape
    v = vectors[ids]
    between = v @ v.transpose(0, 2, 1)
    able = ids >= 0
    closest = np.full((rows, width), -2.0)
    rank = np.full((rows, width), 2 * width, dtype=np.int64)  # chosen ones first, then the others by nearness
    count = np.zeros(rows, dtype=np.int64)
    for k in range(width):
        take = able[:, k] & (closest[:, k] < sims[:, k]) & (count < most)
        rank[:, k] = np.where(take, k, np.where(able[:, k], width + k, 3 * width))
        count += take
        np.maximum(closest, between[:, k], out=closest, where=take[:, None])
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def places_of(layer: int, links: int = LINKS) -> int:
    return 2 * links if layer == 0 else links


class Graph:
    """Flat arrays of one shard. Layer l holds `count[l]` nodes: those of smallest position."""

    def __init__(self, vectors: np.ndarray, seed: int = 0, links: int = LINKS) -> None:
        n = len(vectors)
        self.links = links
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(links)).astype(np.int64), 12)
        self.order = np.argsort(-levels, kind="stable")  # nodes of higher layers come first
        # single precision is faster to choose links by, and enough unless vectors nearly coincide
        coarse = np.ascontiguousarray(np.round(vectors, 3).astype(np.float32) + np.float32(0))
        apart = n < 2 or len(np.unique(coarse.view(np.dtype((np.void, 4 * coarse.shape[1]))).ravel())) == n
        self.vectors = vectors[self.order].astype(np.float32 if apart else np.float64)
        self.count = [int((levels >= layer).sum()) for layer in range(int(levels.max(initial=0)) + 1)]
        self.neighbours = [np.full((k, places_of(layer, links) + TREE), -1, dtype=np.int32) for layer, k in enumerate(self.count)]
        self.visited = 0
        done = min(n, 1)
        while done < n:  # the nodes of the higher layers are inserted first
            upto = min(n, done + min(done, TOGETHER))
            self._insert(done, upto)
            done = upto
        self.vectors = vectors[self.order]

    @classmethod
    def of(cls, vectors: np.ndarray, order: np.ndarray, count: list[int], neighbours: list[np.ndarray]) -> Graph:
        """A graph that was built before."""
        made = cls.__new__(cls)
        made.vectors, made.order, made.count, made.neighbours, made.visited = vectors[order], order, count, neighbours, 0
        return made

    def _insert(self, lo: int, hi: int) -> None:
        q = self.vectors[lo:hi]
        at = np.zeros((hi - lo, 1), dtype=np.int64)
        for layer in reversed(range(len(self.count))):
            joins = min(hi, self.count[layer]) - lo  # nodes of the batch that belong to this layer
            known = min(lo, self.count[layer])
            at, sims = self._walk(layer, q, at, BUILD_BREADTH if joins > 0 else 1, known)
            if joins > 0:
                self._link(layer, lo, joins, at[:joins], sims[:joins])

    def _link(self, layer: int, lo: int, joins: int, ids: np.ndarray, sims: np.ndarray) -> None:
        lists, tree = self.neighbours[layer][:, :-TREE], self.neighbours[layer][:, -TREE:]
        places = lists.shape[1]
        new = np.arange(lo, lo + joins)
        for i, parent in zip(new.tolist(), ids[:, 0].tolist()):  # first child and next sibling
            tree[i, 1], tree[parent, 0] = tree[parent, 0], i
        # nodes of one batch do not meet in the graph: they are candidates of each other
        mates = self.vectors[new] @ self.vectors[new].T
        np.fill_diagonal(mates, NONE)
        k = min(places, joins - 1)
        if k:
            near = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            ids = np.concatenate((ids, new[near]), axis=1)
            sims = np.concatenate((sims, np.take_along_axis(mates, near, 1)), axis=1)
        by = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BREADTH]
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        picked = diverse(np.where(sims > NONE, ids, -1), sims, self.vectors, self.links)
        lists[new, : self.links] = picked
        # and back: each picked node takes the new ones in, and keeps a diverse choice where it has too many
        source = np.repeat(new, self.links)[picked.ravel() >= 0]
        target = picked.ravel()[picked.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, times = np.unique(target, return_index=True, return_counts=True)
        for i in range(0, len(nodes), TOGETHER):
            some, n = nodes[i : i + TOGETHER], times[i : i + TOGETHER]
            old = lists[some].astype(np.int64)
            wide = int(n.max())
            step = np.arange(wide)
            more = np.where(step < n[:, None], source[np.minimum(first[i : i + TOGETHER, None] + step, len(source) - 1)], -1)
            more[(more[:, :, None] == old[:, None, :]).any(axis=2)] = -1
            both = np.concatenate((old, more), axis=1)
            s = np.where(both >= 0, np.einsum("ijk,ik->ij", self.vectors[both], self.vectors[some]), NONE)
            by = np.argsort(-s, axis=1, kind="stable")
            both, s = np.take_along_axis(both, by, 1), np.take_along_axis(s, by, 1)
            full = (both >= 0).sum(axis=1) > places
            kept = both[:, :places]
            if full.any():
                kept[full] = diverse(both[full], s[full], self.vectors, places)
            lists[some, : kept.shape[1]] = kept

    def _walk(self, layer: int, q: np.ndarray, entry: np.ndarray, breadth: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, scores) of the beams' ends, the nearest first, among the first `known` nodes of a layer; -1 where there are fewer."""
        rows, n = len(q), known
        width = min(breadth, n)
        seen = np.zeros((rows, n + 1), dtype=bool)  # the last column stands for no neighbour
        seen[:, n] = True
        entry = np.where(entry < 0, n, entry)[:, :width]
        beam = np.full((rows, width), n, dtype=np.int64)
        score = np.full((rows, width), NONE)
        done = np.ones((rows, width), dtype=bool)
        beam[:, : entry.shape[1]] = entry
        fresh = entry < n
        score[:, : entry.shape[1]] = np.where(fresh, np.einsum("ijk,ik->ij", self.vectors[np.where(fresh, entry, 0)], q), NONE)
        done[:, : entry.shape[1]] = ~fresh
        seen[np.arange(rows)[:, None], entry] = True
        self.visited += int(fresh.sum())
        alive = np.arange(rows)
        opened = min(OPENED, width)
        while len(alive):
            open_ = np.where(done[alive], NONE, score[alive])
            pick = np.argpartition(-open_, opened - 1, axis=1)[:, :opened] if opened < width else np.broadcast_to(np.arange(width), open_.shape)
            go = np.take_along_axis(open_, pick, 1) > NONE
            some = go.any(axis=1)
            alive, pick, go = alive[some], pick[some], go[some]
            if not len(alive):
                break
            done[alive[:, None], pick] = True
            around = self.neighbours[layer][np.where(go, beam[alive[:, None], pick], 0)].astype(np.int64)
            around[~go] = -1
            around = around.reshape(len(alive), -1)
            around[(around < 0) | (around >= n)] = n
            around.sort(axis=1)
            fresh = ~seen[alive[:, None], around]
            fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
            seen[alive[:, None], around] = True
            self.visited += int(fresh.sum())
            r, c = np.nonzero(fresh)
            s = np.full(around.shape, NONE)
            s[r, c] = np.einsum("ij,ij->i", self.vectors[around[r, c]], q[alive[r]])
            all_s = np.concatenate((score[alive], s), axis=1)
            keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            score[alive] = np.take_along_axis(all_s, keep, 1)
            beam[alive] = np.take_along_axis(np.concatenate((beam[alive], around), axis=1), keep, 1)
            done[alive] = np.take_along_axis(np.concatenate((done[alive], ~fresh), axis=1), keep, 1)
        best = np.argsort(-score, axis=1, kind="stable")
        score = np.take_along_axis(score, best, 1)
        return np.where(score > NONE, np.take_along_axis(beam, best, 1), -1), score

    def search(self, queries: np.ndarray, breadth: int = BREADTH) -> np.ndarray:
        """(queries, breadth) nodes in the original numbering, about from near to far, -1 where there are fewer."""
        n = len(self.vectors)
        out = np.full((len(queries), min(breadth, n)), -1, dtype=np.int64)
        for i in range(0, len(queries) if n else 0, TOGETHER):
            q = queries[i : i + TOGETHER]
            at = np.zeros((len(q), 1), dtype=np.int64)
            for layer in reversed(range(len(self.count))):  # the beam widens on the way down
                at, _ = self._walk(layer, q, at, breadth if layer == 0 else 8, self.count[layer])
            out[i : i + TOGETHER] = np.where(at >= 0, self.order[at], -1)
        return out


def _nodes(places: int):
    """Drops unusable vectors and joins those of equal direction within a task, before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if v and i is not None and None not in v:
                    x = np.array(v, dtype=np.float64)
                    if np.isfinite(x).all() and x.any():
                        ids.setdefault(direction(x[None])[0].tobytes(), []).append(i)
            rows = [(v, sorted(set(x))[:places]) for v, x in ids.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["vector", "ids"])

    return run


INDEX = "shard int, vectors binary, ids array<long>, id_counts array<int>, node_sizes array<int>, node_order array<int>, layer_counts array<int>, neighbours array<int>"
ASKED = "shard int, block int, query_id long, vector binary"


def nodes_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a unit vector of each node, the number of its vectors, order of the vectors by node)."""
    single = np.ascontiguousarray(unit(vectors).astype(np.float32) + np.float32(0))
    _, of, sizes = np.unique(single.view(np.dtype((np.void, single.dtype.itemsize * single.shape[1]))).ravel(), return_inverse=True, return_counts=True)
    order = np.argsort(of, kind="stable")
    return unit(vectors[order[np.cumsum(sizes) - sizes]]), sizes, order


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of INDEX for each shard of a partition that is sorted by shard and vector."""
    held: list[tuple[int, bytes, list[int]]] = []

    def made() -> pa.RecordBatch:
        every = np.stack([np.frombuffer(r[1]) for r in held])
        units, sizes, by = nodes_of(every)
        graph = Graph(units, seed=held[0][0])
        ids = [held[i][2] for i in by.tolist()]
        row = [held[0][0], every[by].tobytes(), np.concatenate([np.array(x, dtype=np.int64) for x in ids]), np.array([len(x) for x in ids], dtype=np.int32), sizes.astype(np.int32), graph.order.astype(np.int32),
               np.array(graph.count, dtype=np.int32), np.concatenate([x.ravel() for x in graph.neighbours])]
        kinds = [pa.int32(), pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in INDEX.split(", ")])

    for batch in batches:
        for shard, vector, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if held and held[0][0] != shard:
                yield made()
                held = []
            held.append((shard, vector, ids))
    if held:
        yield made()
    give_back()


class Shard:
    """A shard's graph with the vectors and ids of its nodes."""

    def __init__(self, row: dict) -> None:
        counts = row["layer_counts"]
        self.ids, ends = np.array(row["ids"]), np.cumsum(row["id_counts"])
        self.first, self.behind = ends - np.array(row["id_counts"]), ends
        self.vectors = np.frombuffer(row["vectors"]).reshape(len(ends), -1)
        self.sizes = np.array(row["node_sizes"])
        self.heads = np.cumsum(self.sizes) - self.sizes
        lists, at = [], 0
        flat = np.array(row["neighbours"], dtype=np.int32)
        for layer, n in enumerate(counts):
            places = places_of(layer) + TREE
            lists.append(flat[at : at + n * places].reshape(n, places))
            at += n * places
        self.graph = Graph.of(unit(self.vectors[self.heads]), np.array(row["node_order"]), list(counts), lists)

    def answer(self, query_ids: list[int], vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query, id, score) of each query's k nearest of the nodes that its walk ended with."""
        out = []
        for q, found, x in zip(query_ids, self.graph.search(unit(vectors)), vectors):
            nodes = found[found >= 0]
            n = self.sizes[nodes]
            rows = np.repeat(self.heads[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            scores = cosines(x, self.vectors[rows])
            pairs = sorted((-s, i) for s, at in zip(scores.tolist(), rows.tolist()) for i in self.ids[self.first[at] : self.behind[at]].tolist() if i != q)
            out += [(q, i, -s) for s, i in pairs[:k]]
        return out


def _answers(k: int):
    """Answers of a partition's shards: each (shard, block) begins with the shard's row, and its queries follow."""
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for batch in batches:
            at = 0
            kinds = batch.column("query_id").is_null().to_pylist()
            while at < batch.num_rows:
                if kinds[at]:
                    shard = Shard({c.split()[0]: batch.column(c.split()[0])[at].as_py() for c in INDEX.split(", ")})
                    at += 1
                    continue
                upto = at
                while upto < batch.num_rows and not kinds[upto]:
                    upto += 1
                part = batch.slice(at, upto - at)
                asked = np.stack([np.frombuffer(v) for v in part.column("vector").to_pylist()])
                rows = shard.answer(part.column("query_id").to_pylist(), asked, k) if shard else []
                at = upto
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names)
        give_back()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int, *, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows under `is_query`, their k nearest other rows by cosine.

    The distinct directions and the graphs are checkpointed. Shards and query blocks are
    bounded by their parameters; a shard's row of arrays goes once to each of its blocks.
    """
    plain = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    first = plain.select("id", "v").mapInArrow(_nodes(k + 1), "vector binary, ids array<long>")
    usual = F.length("vector")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    salted = first.groupBy("vector", F.pmod(F.xxhash64("ids"), F.lit(16)).alias("s")).agg(least)
    nodes = durable(salted.groupBy("vector").agg(least))
    size = nodes.groupBy(usual.alias("bytes")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bytes").first()
    spark = vectors.sparkSession
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_shards = max(1, -(-size["n"] // shard_rows))
    asks = plain.where("q").select("id", "v").mapInArrow(_nodes(1 << 30), "vector binary, ids array<long>").where(usual == size["bytes"])
    asks = durable(asks.select(F.explode("ids").alias("query_id"), "vector").groupBy("query_id").agg(F.min("vector").alias("vector")))
    n_blocks = max(1, -(-asks.count() // query_block))
    shards = nodes.where(usual == size["bytes"]).select(F.pmod(F.xxhash64("vector"), F.lit(n_shards)).cast("int").alias("shard"), "vector", "ids")
    # sorted by vector: the same graph whatever the order of arrival
    index = durable(shards.repartition(n_shards, "shard").sortWithinPartitions("shard", "vector").mapInArrow(_build, INDEX))
    each = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    graphs = index.withColumn("block", each).withColumn("query_id", F.lit(None).cast("long")).withColumn("vector", F.lit(None).cast("binary"))
    sent = asks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    both = graphs.unionByName(sent, allowMissingColumns=True).repartition(n_shards * n_blocks, "shard", "block").sortWithinPartitions("shard", "block", F.asc_nulls_first("query_id"))
    found = both.mapInArrow(_answers(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
