"""Nearest neighbours by inner product, with a vantage-point tree per shard.

A shard adds one coordinate to its vectors so that all have the same length; for a
query (whose own extra coordinate is 0) the order by distance is then the order by
inner product, and the triangle inequality holds.  A subtree is pruned if the least
distance it can hold, times a factor, exceeds the distance of the k-th best vector
so far.  Factor one is an exact search; a larger one prunes more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyview.session import cut_lineage

PER_SHARD = 4096
PER_BLOCK = 8192
LEAF = 128
FACTOR = 1.05


class Tree:
    """A vantage-point tree over the distinct rows of one shard."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        norms = (vectors * vectors).sum(axis=1)
        self.vectors, self.top = vectors, float(norms.max(initial=0.0))
        self.points = np.concatenate([vectors, np.sqrt(np.maximum(0.0, self.top - norms))[:, None]], axis=1)
        self.leaf = leaf
        self.root = self._grow(np.arange(len(vectors)))

    def _grow(self, rows: np.ndarray):
        """A leaf is its rows; a node is (vantage point, two children with the bounds of their distances)."""
        if len(rows) <= self.leaf:
            return rows
        # The point farthest from the first row lies at the edge, where distances spread.
        start = ((self.points[rows] - self.points[rows[0]]) ** 2).sum(axis=1)
        vantage = self.points[rows[int(start.argmax())]]
        far = np.sqrt(((self.points[rows] - vantage) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        halves = order[:len(order) // 2], order[len(order) // 2:]
        return vantage, [(float(far[h].min()), float(far[h].max()), self._grow(rows[h])) for h in halves]

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows that may be among the k best of a query, ties included."""
        run = Search(self, queries, k, factor)
        run.visit(self.root, np.arange(len(queries)))
        return run.found()


class Search:
    def __init__(self, tree: Tree, queries: np.ndarray, k: int, factor: float):
        self.tree, self.queries, self.k, self.factor = tree, queries, k, factor
        self.base = (queries * queries).sum(axis=1) + tree.top
        self.best = np.full((len(queries), k), -np.inf)
        self.slack = 1e-9 * (1 + self.base)
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reach(self, active: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far."""
        return np.sqrt(np.maximum(0.0, self.base[active] - 2 * self.best[active, 0] + self.slack[active]))

    def visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, active)
            return
        vantage, children = node
        near = self.queries[active] @ vantage[:-1]
        far = np.sqrt(np.maximum(0.0, self.base[active] - 2 * near))
        bounds = [np.maximum(0.0, np.maximum(low - far, far - high)) for low, high, _ in children]
        first = (bounds[1] < bounds[0]).astype(int)
        for turn in (0, 1):
            for side in (0, 1):
                own = (first == side) if turn == 0 else (first != side)
                keep = own & (bounds[side] * self.factor <= self.reach(active))
                self.visit(children[side][2], active[keep])

    def _scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        scores = self.queries[active] @ self.tree.vectors[rows].T
        a, b = np.nonzero(scores >= (self.best[active, 0] - self.slack[active])[:, None])
        self.hits.append((active[a], rows[b], scores[a, b]))
        some = np.unique(a)
        merged = np.concatenate([self.best[active[some]], scores[some]], axis=1)
        self.best[active[some]] = np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k:]
        self.best[active[some], 0] = self.best[active[some]].min(axis=1)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, row, score = (np.concatenate([h[i] for h in self.hits]) for i in range(3))
        keep = score >= self.best[query, 0] - self.slack[query]
        return query[keep], row[keep]


def nearest_in_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                     factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of the k best of each query in the shard, its own id left out.

    Equal vectors are one row of the tree; of their ids the k + 1 smallest are enough.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, group = np.unique(vectors, axis=0, return_inverse=True)
    by_group = np.argsort(group.ravel(), kind="stable")
    begins = np.searchsorted(group.ravel()[by_group], np.arange(len(distinct) + 1))
    query, row = Tree(distinct).search(queries, k + 1, factor)
    counts = np.minimum(begins[row + 1] - begins[row], k + 1)
    query, first = query.repeat(counts), begins[row].repeat(counts)
    row = row.repeat(counts)
    at = first + np.arange(len(first)) - (np.cumsum(counts) - counts).repeat(counts)
    found = ids[by_group[at]]
    other = found != query_ids[query]
    query, row, found = query[other], row[other], found[other]
    # One way of summing for all rows, so equal vectors have equal scores.
    score = np.concatenate([np.zeros(0), *((queries[query[i:i + 65536]] * distinct[row[i:i + 65536]]).sum(axis=1)
                                           for i in range(0, len(query), 65536))])
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    keep = rank < k
    return query_ids[query[keep]], found[keep], score[keep]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles), dim; without null, empty, zero and non-finite vectors and null ids."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.filter(fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = FACTOR, per_shard: int = PER_SHARD,
            per_block: int = PER_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by inner product, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the
    query's own id.  Shards of about ``per_shard`` rows meet blocks of about ``per_block``
    queries, each pair in a task of its own, whatever their numbers.  Only vectors of equal
    dimension are compared.  Vectors that are null, zero or hold null or non-finite entries
    take no part; an empty table gives no rows.  Repeated ids are candidates of their own.
    """
    rows = cut_lineage(usable(vectors, id_col, vector_col))
    asked = rows.filter(F.col("vec_id") % every == 0)
    shards = -(-max(1, rows.count()) // per_shard)
    blocks = -(-max(1, asked.count()) // per_block)

    def dealt(name: str, parts: int, salt: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int").alias(name)

    index = rows.select("dim", "vec_id", "v", dealt("shard", shards, 1),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = asked.select("dim", "vec_id", "v", dealt("block", blocks, 2),
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def matrix(table: pa.Table) -> np.ndarray:
        column = table["v"].combine_chunks()
        return column.flatten().to_numpy().reshape(table.num_rows, -1)

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not mine.num_rows or not others.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        return pa.table([pa.array(x) for x in nearest_in_shard(
            mine["vec_id"].to_numpy(), matrix(mine), others["vec_id"].to_numpy(), matrix(others), k, factor)], names)

    keys = ["dim", "shard", "block"]
    found = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
