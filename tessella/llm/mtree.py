"""Exact top-k by inner product with M-trees and best-first search.

Rows are dealt to shards of bounded size and each shard builds an M-tree: pages of rows below routing objects, each node with its
covering radius and the distance of every entry to the routing object above it. For a largest norm M, a row x is seen as the point
(x, sqrt(M^2 - |x|^2)) and a query q as (q, 0): their squared distance is |q|^2 + M^2 - 2 q.x, so nearer means a larger
inner product, and the triangle inequality holds.

Queries go in waves of bounded size to every shard; a task builds the tree of its shard and asks it all queries of one wave, so no tree
is sent anywhere. Each query visits nodes by their lower bound and stops where no node can beat its k-th best; entries
whose stored distance to the routing object excludes them are not computed. Each shard returns k rows a query at most, and Spark ranks them.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import column


@dataclass(frozen=True)
class TreeParams:
    k: int = 20
    scale: int = 64
    #: Rows in a shard: at most, and at least where there are not ``least_shards`` such shards.
    shard_rows: int = 65_536
    small_shard_rows: int = 4_096
    least_shards: int = 32
    page_rows: int = 1_024
    fanout: int = 32
    #: Queries that one task asks its tree.
    wave_queries: int = 32_768

    def shards(self, rows: int) -> int:
        return max(1, -(-rows // self.shard_rows), min(self.least_shards, -(-rows // self.small_shard_rows)))


def _exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers as floats where every inner product is then exact, else as Python integers."""
    top = float(np.abs(x).max(initial=0))
    return x.astype(np.float64) if top * top * max(1, x.shape[1]) < 2**52 else np.array([[int(v) for v in r] for r in x], dtype=object)


def _ordered(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: larger scores, then smaller ids."""
    if len(score) > 4 * k:
        limit = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= limit)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


class MTree:
    """Nodes are (routing point, radius, None or (points, radii, numbers) of the children, first row, end row, distances of the entries to
    the routing point)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, p: TreeParams):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.p = ids[order], _exact(x[order]), p
        norm = np.array([int(r @ r) for r in self.x], dtype=np.float64) if self.x.dtype == object else np.einsum("ij,ij->i", self.x, self.x)
        self.top = float(norm.max(initial=0))
        self.points = np.column_stack([self.x.astype(np.float64), np.sqrt(np.maximum(self.top - norm, 0))])
        self.rows: list[int] = []
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(ids)))
        #: Inner products computed so far.
        self.computed = 0
        rows = np.array(self.rows, dtype=np.int64)
        self.ids, self.x, self.points = self.ids[rows], self.x[rows], self.points[rows]

    @staticmethod
    def _gap(points: np.ndarray, point: np.ndarray) -> np.ndarray:
        d = points - point
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _far(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return self._gap(self.points[rows], point)

    def _build(self, rows: np.ndarray) -> int:
        route = self.points[rows].mean(axis=0)
        far = self._far(rows, route)
        route = self.points[rows[int(np.argmin(far))]] if len(rows) else route
        far = self._far(rows, route)
        if len(rows) <= self.p.page_rows:
            first = len(self.rows)
            self.rows.extend(rows.tolist())
            self.nodes.append((route, far.max(initial=0.0), None, first, len(self.rows), far))
            return len(self.nodes) - 1
        spread = np.unique(np.linspace(0, len(rows) - 1, min(self.p.fanout, 2 * -(-len(rows) // self.p.page_rows))).astype(np.int64))
        apart = np.stack([self._far(rows, self.points[rows[k]]) for k in spread])
        owner = np.argmin(apart, axis=0)
        if len(np.unique(owner)) == 1:  # copies of one point fill pages evenly
            owner = np.arange(len(rows)) * self.p.fanout // len(rows)
        children = [self._build(rows[owner == k]) for k in np.unique(owner)]
        below = np.stack([self.nodes[c][0] for c in children]), np.array([self.nodes[c][1] for c in children]), np.array(children)
        self.nodes.append((route, far.max(initial=0.0), below, 0, 0, self._gap(below[0], route)))
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, without one row that is the query itself (its id and its vector)."""
        k = self.p.k
        point = np.append(q.astype(np.float64), 0.0)
        square = float(point @ point) + self.top
        slack = 1e-9 * square + 1e-9
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        least, limit, met = -np.inf, np.inf, False

        def reach(score: float) -> float:
            return np.sqrt(max(0.0, square - 2 * score) + slack)

        away = float(np.linalg.norm(self.nodes[self.root][0] - point))
        heap = [(max(0.0, away - self.nodes[self.root][1]), self.root, away)]
        while heap:
            bound, at, away = heapq.heappop(heap)
            if bound > limit:
                break
            _, _, children, first, end, up = self.nodes[at]
            if children is not None:
                routes, radii, numbers = children
                near = np.flatnonzero(np.abs(up - away) - radii <= limit)
                d = self._gap(routes[near], point)
                bounds = d - radii[near]
                for c in np.flatnonzero(bounds <= limit).tolist():
                    heapq.heappush(heap, (max(0.0, float(bounds[c])), int(numbers[near[c]]), float(d[c])))
                continue
            use = np.flatnonzero(np.abs(up - away) <= limit)
            self.computed += len(use)
            score = self.x[first:end] @ q if len(use) == end - first else self.x[first + use] @ q
            good = np.flatnonzero(score >= least)
            if not met:
                same = [g for g in good[self.ids[first + use[good]] == own] if (self.x[first + use[g]] == q).all()]
                if same:
                    good, met = good[good != same[0]], True
            if len(good):
                ids, scores = np.concatenate([ids, self.ids[first + use[good]]]), np.concatenate([scores, score[good]])
                best = _ordered(scores, ids, k)
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = scores[-1]
                    limit = reach(float(least))
        return ids, scores


def quantised(vectors: DataFrame, p: TreeParams = TreeParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dims, q): floor(scale * component) as packed whole numbers, of 2 bytes where they fit, else of 4, else as floats.

    Null ids, null or empty vectors and those with null or non-finite components are left out; so are those with a component
    whose square a double cannot hold (over 1e150 when scaled), which only a column of doubles can have.
    """

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(id_col), batch.column(vector_col)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(p.scale * flat)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            bad = np.concatenate([[0], np.cumsum(~(np.abs(values) <= 1e150))])
            use = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & (at[1:] > at[:-1]) & (bad[at[1:]] == bad[at[:-1]]))
            packed = []
            for k in use.tolist():
                v = values[at[k] : at[k + 1]]
                top = np.abs(v).max()
                packed.append(v.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(use)).cast(pa.int64()), pa.array(np.diff(at)[use], pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "dims", "q"])

    return vectors.select(id_col, vector_col).mapInArrow(run, "vec_id long, dims int, q binary")


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    if len({len(b) for b in packed}) == 1:
        return np.frombuffer(b"".join(packed), f"<{'f' if len(packed[0]) == 8 * dims else 'i'}{len(packed[0]) // dims}").reshape(len(packed), dims)
    return np.array([np.frombuffer(b, f"<{'f' if len(b) == 8 * dims else 'i'}{len(b) // dims}").astype(float) for b in packed]).reshape(len(packed), dims)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("wide", pa.float64())])


def top_k(vectors: DataFrame, every: int = 20, p: TreeParams = TreeParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k other rows with the largest inner products.

    Ties go to the smaller id. Rows compare with rows of their own length only. Of rows that repeat a query's id one asks (the
    first by packed vector); the others are candidates like any row. A score that a long cannot hold is given as the nearest long, and
    such scores rank as doubles.
    """
    rows = quantised(vectors, p, id_col, vector_col)
    n, asked = vectors.agg(F.count(F.lit(1)), F.count_if(F.col(id_col) % every == 0)).first()
    shards, waves = p.shards(n), max(1, -(-asked // p.wave_queries))

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if len(rows) and len(asked):
            dims = column(rows, "dims")[0].as_py()
            tree = MTree(column(rows, "vec_id").to_numpy(), _matrix(column(rows, "q").to_pylist(), dims), p)
            pairs = sorted(zip(column(asked, "vec_id").to_pylist(), column(asked, "q").to_pylist()))
            pairs = [x for k, x in enumerate(pairs) if not k or pairs[k - 1][0] != x[0]]
            own, x = [i for i, _ in pairs], _exact(_matrix([q for _, q in pairs], dims))
            for i, q in zip(own, x):
                ids, scores = tree.search(q, i)
                parts.append((np.full(len(ids), i), ids, np.array([min(max(int(v), -(2**63)), 2**63 - 1) for v in scores], np.int64), scores.astype(float)))
        return pa.table([np.concatenate([x[k] for x in parts]) if parts else np.zeros(0) for k in range(4)], schema=_FOUND)

    numbers = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    keys = ["shard", "wave", "dims"]
    held = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "q"), F.lit(shards)).cast("int")).withColumn("wave", numbers(waves))
    asking = rows.where(F.col("vec_id") % every == 0).withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(waves)).cast("int")).withColumn("shard", numbers(shards))
    found = held.groupBy(keys).cogroup(asking.groupBy(keys)).applyInArrow(search, "query_id long, vec_id long, score long, wide double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
