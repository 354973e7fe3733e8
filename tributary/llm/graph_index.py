"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.text import cut

#: Vectors in a shard, about; edges a vector keeps; nearest so far that an insertion holds; how much nearer to a kept neighbour than to the vector
#: itself another must be to be pruned.
SHARD_ROWS, DEGREE, BEAM, ALPHA = 4096, 40, 96, 1.2
#: Nearest so far that a query's search holds.
QUERY_BEAM = 192
#: Spread-out vectors from which searches start, and how many of them a search starts from.
ENTRIES, STARTS = 256, 8
#: Vectors of a beam that are expanded in one step, and searches that run side by side.
EXPANDED, TOGETHER = 4, 256
ROW = "shard long, dim int, query_id long, vec binary, ids array<long>"


class Graph:
    """A directed graph over distinct vectors, built by inserting them in growing batches."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> None:
        self.x = vectors.astype(np.float32)
        # Scaled so that squares neither overflow nor vanish; the order of distances stays.
        self.x /= max(np.abs(self.x).max(initial=0), np.float32(1e-30))
        self.square = np.einsum("nd,nd->n", self.x, self.x)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        n = len(vectors)
        self.edges = np.full((n, degree), -1, np.int64)
        rng = np.random.default_rng(5)
        self.entries = self.spread_out(min(n, ENTRIES), rng)
        # Entries know the others; all else is found from them.
        others = np.broadcast_to(self.entries, (len(self.entries), len(self.entries)))
        self.edges[self.entries] = self.prune(self.entries, others)
        order = rng.permutation(n)
        order = order[~np.isin(order, self.entries)]
        done = 0
        while done < len(order):
            new = order[done : done + min(len(self.entries) + done, TOGETHER)]
            self.insert(new)
            done += len(new)

    def spread_out(self, count: int, rng: np.random.Generator) -> np.ndarray:
        """Vectors picked one by one, with chances that grow with the squared distance to those picked before, so that clusters far from all others have one."""
        picked = [int(rng.integers(len(self.x)))]
        least = np.full(len(self.x), np.inf)
        while len(picked) < count:
            difference = (self.x - self.x[picked[-1]]).astype(np.float64)
            least = np.minimum(least, np.einsum("nd,nd->n", difference, difference))
            least[picked] = 0
            total = least.cumsum()
            if not total[-1] > 0:  # all others are as good as equal to one picked
                break
            picked.append(min(int(np.searchsorted(total, rng.random() * total[-1], "right")), len(self.x) - 1))
        return np.unique(picked)

    def near(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances between each query and its row of ``ids``; infinite for ids that are -1."""
        difference = self.x[ids] - queries[:, None]
        return np.where(ids < 0, np.inf, np.einsum("mkd,mkd->mk", difference, difference))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search from the entries nearest to each query: ids and squared distances of the nearest vectors found, nearest first."""
        m, n = len(queries), len(self.x)
        seen = np.zeros((m, n + 1), bool)  # the last column stands for no vector
        ids, dist, open_ = np.full((m, beam), -1), np.full((m, beam), np.inf), np.zeros((m, beam), bool)
        starts = min(STARTS, beam, len(self.entries))
        far = self.square[self.entries] - 2 * queries @ self.x[self.entries].T
        first = self.entries[np.argpartition(far, starts - 1, axis=1)[:, :starts]]
        length = self.near(queries, first)
        order = np.argsort(length, axis=1, kind="stable")
        ids[:, :starts], dist[:, :starts], open_[:, :starts] = np.take_along_axis(first, order, 1), np.take_along_axis(length, order, 1), True
        seen[np.arange(m)[:, None], first] = True
        seen[:, n] = True
        active = np.arange(m)
        while len(active):
            rank = np.where(open_[active], np.arange(beam), beam)
            first = np.sort(np.partition(rank, EXPANDED - 1, axis=1)[:, :EXPANDED], axis=1) if beam > EXPANDED else np.sort(rank, axis=1)
            going = first[:, 0] < beam
            active, first = active[going], first[going]
            if not len(active):
                break
            at = np.minimum(first, beam - 1)
            chosen = np.where(first < beam, np.take_along_axis(ids[active], at, 1), -1)
            rows = np.repeat(active, chosen.shape[1])
            open_[rows, at.ravel()] = False
            fresh = np.where(chosen[..., None] < 0, -1, self.edges[chosen]).reshape(len(active), -1)
            fresh = np.where(seen[active[:, None], fresh], -1, fresh)
            # The same vector may be reached from two of the expanded ones.
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            seen[active[:, None], fresh] = True
            both = np.concatenate((ids[active], fresh), axis=1)
            length = np.concatenate((dist[active], self.near(queries[active], fresh)), axis=1)
            opened = np.concatenate((open_[active], fresh >= 0), axis=1)
            best = np.argsort(length, axis=1, kind="stable")[:, :beam]
            ids[active], dist[active], open_[active] = (np.take_along_axis(x, best, 1) for x in (both, length, opened))
            open_[active] &= np.isfinite(dist[active])
        return np.where(np.isfinite(dist), ids, -1), dist

    def prune(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """For each point the nearest candidate, then again and again the nearest of those not much nearer to one kept than to the point."""
        out = np.full((len(points), self.degree), -1, np.int64)
        for a in range(0, len(points), 64):
            own, ids = points[a : a + 64], candidates[a : a + 64]
            ids = np.where(ids == own[:, None], -1, ids)
            dist = self.near(self.x[own], ids)
            order = np.argsort(dist, axis=1, kind="stable")
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            alive = np.isfinite(dist)
            x = self.x[ids] - self.x[own][:, None]
            each = np.einsum("mkd,mkd->mk", x, x)
            apart = np.maximum(each[:, :, None] + each[:, None, :] - 2 * x @ x.transpose(0, 2, 1), 0)
            rows = np.arange(len(own))
            for k in range(self.degree):
                pick = alive.argmax(axis=1)
                there = alive[rows, pick]
                if not there.any():
                    break
                out[a : a + 64, k] = np.where(there, ids[rows, pick], -1)
                alive[rows, pick] = False
                alive &= (self.alpha**2 * apart[rows, pick] > dist) | ~there[:, None]
        return out

    def insert(self, new: np.ndarray) -> None:
        found, _ = self.search(self.x[new], self.beam)
        self.edges[new] = self.prune(new, found)
        # Back edges: to each neighbour from the new vectors that chose it; who has too many prunes.
        to, back = self.edges[new].ravel(), np.repeat(new, self.degree)
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        targets, start, count = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(targets), int(count.max(initial=0))), -1, np.int64)
        wide[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(start, count)] = back
        both = np.concatenate((self.edges[targets], wide), axis=1)
        many = (both >= 0).sum(axis=1) > self.degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : self.degree]
        self.edges[targets[~many]] = packed[~many]
        self.edges[targets[many]] = self.prune(targets[many], both[many])


def distances(x: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares overflow."""
    with np.errstate(over="ignore"):
        difference = x - vector
        found = np.sqrt((difference**2).sum(axis=1))
        large = np.isinf(found)
        if large.any():
            most = np.abs(x[large] / 2 - vector / 2).max(axis=1)
            found[large] = 2 * most * np.sqrt((((x[large] / 2 - vector / 2) / most[:, None]) ** 2).sum(axis=1))
    return found


def smallest(ids: list[np.ndarray], count: int) -> list[int]:
    return np.unique(np.concatenate(ids))[:count].tolist()


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """(vec_id, dim, vec, ids): valid vectors as doubles, those of one batch that are equal in one row with their ``keep`` smallest ids, which are
    all that a search for ``keep`` - 1 others can return."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list[int]] = {}
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = vector.values
                if vec_id is None or values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    groups.setdefault((x + 0.0).tobytes(), []).append(vec_id)
            ids = [sorted(set(x))[:keep] for x in groups.values()]
            yield pa.record_batch(
                [pa.array([len(v) // 8 for v in groups], pa.int32()), pa.array(list(groups), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["dim", "vec", "ids"]
            )

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(work, "dim int, vec binary, ids array<long>")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` nearest rows of ``vectors`` found, both (vec_id, embedding).

    Score is the Euclidean distance in double precision; ties go to the smaller id; a row whose id is the query's takes no part. Equal vectors share a
    node of a graph. Shards hold about ``shard_rows`` distinct vectors of one dimension, dealt by a hash of the vector, and every query visits every shard of its
    dimension: vectors first, then queries, which stream through in blocks. Null ids and vectors, empty and zero vectors, and
    those with null or non-finite components take no part; repeated rows count once; an empty table gives none.
    """
    parts = cut(distinct_vectors(vectors, k + 1))
    sizes = {r["dim"]: r["n"] for r in parts.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shards = F.lit(1)
    for dim, n in sizes.items():
        shards = F.when(F.col("dim") == dim, -(-n // shard_rows)).otherwise(shards)
    rows = parts.select((F.pmod(F.xxhash64("vec"), shards)).cast("long").alias("shard"), "dim", F.lit(None).cast("long").alias("query_id"), "vec", "ids")
    asked = distinct_vectors(queries, 1 << 30).select("dim", "vec", F.explode("ids").alias("query_id"))
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), (shards - 1).cast("long"))).alias("shard"), "dim", "query_id", "vec", F.array().cast("array<long>").alias("ids"))
    total = sum(-(-n // shard_rows) for n in sizes.values())
    dealt = rows.unionByName(asked).repartition(max(1, 2 * total), "shard", "dim")
    dealt = dealt.sortWithinPartitions("dim", "shard", F.col("query_id").asc_nulls_first())

    def answer(graph: Graph, x: np.ndarray, ids: list[list[int]], asked: list[tuple[int, bytes]]) -> pa.RecordBatch:
        out: list[tuple[int, int, float]] = []
        q = np.stack([np.frombuffer(v) for _, v in asked])
        scaled = (q / max(np.abs(x).max(), 1e-30)).astype(np.float32)
        found, _ = graph.search(scaled, max(beam, k + 1))
        for (query_id, _), vector, near in zip(asked, q, found):
            near = near[near >= 0]
            exact = distances(x[near], vector)
            rows = sorted((d, i) for d, node in zip(exact.tolist(), near.tolist()) for i in ids[node] if i != query_id)[:k]
            out += [(query_id, i, d) for d, i in rows]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, nodes, waiting = None, {}, []
        graph = x = ids = None
        for batch in batches:
            for shard, dim, query_id, vec, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, dim) != here:
                    if waiting and graph:
                        yield answer(graph, x, ids, waiting)
                    here, nodes, waiting, graph = (shard, dim), {}, [], None
                if query_id is None:
                    nodes.setdefault(vec, []).append(np.asarray(own))
                elif nodes:
                    if graph is None:
                        x = np.stack([np.frombuffer(v) for v in nodes])
                        ids = [smallest(v, k + 1) for v in nodes.values()]
                        graph = Graph(x)
                    waiting.append((query_id, vec))
                    if len(waiting) == TOGETHER:
                        yield answer(graph, x, ids, waiting)
                        waiting = []
        if waiting and graph:
            yield answer(graph, x, ids, waiting)

    found = dealt.mapInArrow(work, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
