"""Approximate nearest neighbours over sharded, robust-pruned directed graphs.

Vectors are dealt to shards by a hash of their id. In each shard a graph is grown in batches: a greedy beam search from the medoid
proposes neighbours for each new point, relaxed distance pruning keeps those that no closer kept one covers, and the edges
are also entered backwards. Queries run a beam search in every shard, and the nearest of all shards are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
WIDTH = 4  # nodes of a beam expanded at a time
BATCH = 256
INF = np.float32(np.inf)


def _once(rows: np.ndarray) -> np.ndarray:
    """Each row sorted, with repeated entries replaced by -1."""
    rows = np.sort(rows, axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
    return rows


def _distances(x: np.ndarray, points: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Squared distances from each point to its row of indexes; infinite for -1."""
    gap = x[idx] - points[:, None, :]
    d = np.einsum("bcd,bcd->bc", gap, gap)
    d[idx < 0] = INF
    return d


class Graph:
    """A robust-pruned graph over distinct vectors."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        self.edges = np.full((n, DEGREE), -1, np.int32)
        self.starts = np.array([np.argmin(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1))], np.int32)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        order = np.concatenate([self.starts, order[order != self.starts[0]]])
        done = 1
        while done < n:
            batch = order[done:done + min(done, BATCH)]
            self._insert(batch)
            done += len(batch)
        self._reach()

    def _insert(self, batch: np.ndarray) -> None:
        beam, _, seen = self.search(self.x[batch], BEAM)
        self.edges[batch] = self._prune(batch, np.concatenate([beam, seen], axis=1))
        new = self.edges[batch]
        source = np.repeat(batch, DEGREE)[new.ravel() >= 0]
        target = new.ravel()[new.ravel() >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(nodes), count.max()), -1, np.int32)
        rank = np.arange(len(target)) - np.repeat(first, count)
        back[np.repeat(np.arange(len(nodes)), count), rank] = source
        for at in range(0, len(nodes), BATCH):
            some = slice(at, at + BATCH)
            self.edges[nodes[some]] = self._prune(nodes[some], np.concatenate([self.edges[nodes[some]], back[some]], axis=1))

    def _prune(self, points: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """Of the proposed neighbours, the closest is kept and those it covers are struck out, and so on up to DEGREE."""
        proposed = np.where(proposed == points[:, None], -1, proposed)
        proposed = _once(proposed)
        d = _distances(self.x, self.x[points], proposed)
        g = self.x[proposed]
        norm = np.einsum("bcd,bcd->bc", g, g)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (g @ g.transpose(0, 2, 1))
        kept = np.full((len(points), DEGREE), -1, np.int32)
        rows, open_d = np.arange(len(points)), d.copy()
        for r in range(DEGREE):
            j = open_d.argmin(axis=1)
            live = np.isfinite(open_d[rows, j])
            if not live.any():
                break
            kept[live, r] = proposed[rows, j][live]
            covered = ALPHA * ALPHA * between[rows, j] <= d
            open_d[covered & live[:, None]] = INF
            open_d[rows, j] = INF
        return kept

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beam search: (nearest indexes, squared distances, expanded nodes), -1 where there are fewer."""
        q, n = len(queries), len(self.x)
        seen = np.zeros((q, n + 1), bool)  # the last column takes the -1s
        idx = np.broadcast_to(self.starts, (q, len(self.starts))).copy()
        seen[:, self.starts] = True
        d = _distances(self.x, queries, idx)
        spent = np.zeros_like(idx, bool)
        rows, trail = np.arange(q)[:, None], []
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            idx, d, spent = np.take_along_axis(idx, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(spent, order, 1)
            todo = ~spent & np.isfinite(d)
            if not todo.any():
                break
            chosen = todo & (np.cumsum(todo, axis=1) <= WIDTH)
            place = np.argsort(~chosen, axis=1, kind="stable")[:, :WIDTH]
            expand = np.where(np.take_along_axis(chosen, place, 1), np.take_along_axis(idx, place, 1), -1)
            spent |= chosen
            trail.append(expand)
            near = np.where(expand[:, :, None] >= 0, self.edges[expand], -1).reshape(q, -1)
            near = _once(np.where(seen[rows, near], -1, near))
            seen[rows, near] = True
            seen[:, -1] = False
            idx = np.concatenate([idx, near], axis=1)
            d = np.concatenate([d, _distances(self.x, queries, near)], axis=1)
            spent = np.concatenate([spent, near < 0], axis=1)
        return np.where(np.isfinite(d), idx, -1), d, np.concatenate(trail, axis=1)

    def _reach(self) -> None:
        """Points that no path from the medoid reaches become starts of their own."""
        found = np.zeros(len(self.x), bool)
        front = self.starts
        while True:
            while len(front):
                found[front] = True
                front = np.unique(self.edges[front])
                front = front[(front >= 0)]
                front = front[~found[front]]
            lost = np.nonzero(~found)[0]
            if not len(lost):
                return
            front = lost[:1].astype(np.int32)
            self.starts = np.concatenate([self.starts, front])


class Shard:
    """Vectors of one shard and length with their ids; equal vectors are one point of the graph.

    The graph works on single-precision copies, scaled and centred so that they keep as many digits as they can; distances are
    taken from the vectors themselves.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        vectors = vectors + 0.0  # -0 becomes 0
        points, of = np.unique(vectors, axis=0, return_inverse=True)
        by = np.argsort(of.ravel(), kind="stable")
        self.ids, counts = ids[by], np.bincount(of.ravel(), minlength=len(points))
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts
        self.points = points
        self.unit = np.ldexp(1.0, min(1000, -int(np.frexp(np.abs(points).max())[1])))
        self.centre = (points * self.unit).mean(axis=0)
        self.graph = Graph(self._placed(points))

    def _placed(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors * self.unit - self.centre).astype(np.float32)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        out = []
        for at in range(0, len(ids), BATCH):
            q = queries[at:at + BATCH]
            found, _, _ = self.graph.search(self._placed(q), max(SEARCH_BEAM, k + 1))
            for own, query, near in zip(ids[at:at + BATCH].tolist(), q, found, strict=True):
                near = near[near >= 0]
                d = np.sqrt(((self.points[near] - query) ** 2).sum(axis=1))
                best = []
                for distance, p in sorted(zip(d.tolist(), near.tolist(), strict=True)):
                    if len(best) >= k and distance > best[k - 1][0]:
                        break
                    # equal vectors are sorted by id: the first k besides the query's own suffice
                    copies = self.ids[self.begins[p]:min(self.ends[p], self.begins[p] + k + 1)].tolist()
                    best = sorted(best + [(distance, c) for c in copies if c != own])[:k]
                out += [(own, c, distance) for distance, c in best]
        return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows (vec_id, v) that take part: with an id, and a vector without NULL or non-finite components that is not zero."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.forall(v, lambda x: x == 0)
    return vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & ~zero)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, first value, length) of the lists."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(), offsets[:-1], np.diff(offsets)


def _by_length(ids: np.ndarray, column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    values, first, length = _lists(column)
    found = {}
    for size in np.unique(length).tolist():
        rows = np.nonzero(length == size)[0]
        found[size] = ids[rows], values[first[rows][:, None] + np.arange(size)[None, :]]
    return found


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding",
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest rows found for each query, a row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. All rows are indexed. A shard
    holds about ``shard_rows`` vectors; the queries are copied to every shard, and merged rows are ``k`` per query and shard.
    Ids or vectors that are NULL, zero, or hold NULL or non-finite components take no part. Vectors of different lengths have no distance:
    each length has graphs of its own, and a query is answered from its length. Rows that repeat an id are one candidate (the first in order
    of components), an empty table gives no rows.
    """
    good = usable(vectors, vec_id, embedding)
    shards = max(1, -(-good.count() // shard_rows))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    rows = good.select(home.alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    queries = good.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = rows.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, built = None, [], None
        for batch in batches:
            numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: list[tuple[int, int, float]] = []
            borders = np.nonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0))[0] + 1
            for begin, end in zip([0, *borders.tolist()], [*borders.tolist(), len(numbers)], strict=True):
                if begin == end:
                    continue
                if numbers[begin] != shard:
                    shard, parts, built = numbers[begin], [], None
                piece = batch.slice(begin, end - begin)
                if kinds[begin] == 0:
                    parts.append(piece)
                elif parts:
                    if built is None:
                        whole = pa.Table.from_batches(parts).combine_chunks()
                        keys, once = np.unique(whole.column("vec_id").to_numpy(), return_index=True)  # rows come sorted by id and vector
                        lists = whole.column("v").take(pa.array(once)).combine_chunks()
                        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                        built = {size: Shard(*of) for size, of in _by_length(keys, lists).items()}
                    for size, (keys, asked) in _by_length(piece.column("vec_id").to_numpy(), piece.column("v")).items():
                        if size in built:
                            out += built[size].nearest(keys, asked, k)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                                             names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
