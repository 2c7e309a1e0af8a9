"""Exact top-k search by aggregation of sorted lists without random access.

Candidates are dealt to shards; a shard holds, for every dimension, its candidates sorted by that component. The lists
are read in step from both ends. What has been read of a candidate adds to its score exactly; a component not yet read
lies between the two frontiers of its list, which bounds the rest from below and above. Reading stops for a query when
few candidates remain whose upper bound reaches the k-th best lower bound: no outsider can qualify. Their final scores
are then resolved. All queries of a block share the reading depth, so that bounds of a block are matrix products.

Queries meet every shard in blocks (a stated query set against all rows); a task holds at most about one shard and one
block, whatever the size of the table.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
padded with zeros; rows with the query's own id are not its candidates; equal scores rank by id; repeated rows are
candidates of their own; fewer candidates than k give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import read, staged

K = 20
SHARD, BLOCK = 8192, 8192
DEPTHS = (0.25, 0.375, 0.4375)


def quantised(vector: Column) -> Column:
    """floor(64 * x) of every component; null if the vector takes no part."""
    x = vector.cast("array<double>")
    bad = x.isNull() | F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda c: F.floor(c * 64).cast("long")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of longs, padded with zeros to ``width``."""
    rows = column.combine_chunks()
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    size = rows.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), width), np.int64)
    out[np.arange(width) < size[:, None]] = rows.flatten().to_numpy()
    return out


def _kind(x: np.ndarray, q: np.ndarray) -> type:
    """The cheapest type in which all inner products are exact integers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


class SortedLists:
    """The candidates of a shard as one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.lists = np.argsort(self.x, axis=0, kind="stable")

    def read(self, depth: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """After ``depth`` entries from both ends of all lists: the components read (else 0), what is unread, and the frontiers."""
        n, width = self.x.shape
        got = np.zeros((n, width), kind)
        unread = np.ones((n, width), kind)
        for part in (self.lists[:depth], self.lists[n - depth :]):
            np.put_along_axis(got, part, np.take_along_axis(self.x, part, 0).astype(kind), 0)
            np.put_along_axis(unread, part, 0, 0)
        cols = np.arange(width)
        low, high = self.x[self.lists[depth - 1], cols], self.x[self.lists[n - depth], cols]
        return got, unread, low.astype(kind), high.astype(kind)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, positions and exact scores of its best k candidates (those with its own id left out)."""
        n = len(self.ids)
        kind = _kind(self.x, queries)
        out: list = [None] * len(queries)
        left = np.arange(len(queries))
        few = max(4 * k, n // 16)
        spare = k + 1 + int(np.unique(self.ids, return_counts=True)[1].max(initial=1)) - 1
        for share in DEPTHS:
            depth = int(n * share)
            if depth == 0 or len(left) == 0 or n <= few:
                break
            got, unread, low, high = self.read(depth, kind)
            q = queries[left].astype(kind)
            seen = got @ q.T
            ends = np.stack([q * low, q * high])
            lower, upper = seen + unread @ ends.min(0).T, seen + unread @ ends.max(0).T
            floor = np.partition(lower, n - min(spare, n), axis=0)[n - min(spare, n)]
            alive = upper >= floor
            done = alive.sum(0) <= few
            for j in np.flatnonzero(done):
                out[left[j]] = self._resolve(np.flatnonzero(alive[:, j]), queries[left[j]], own[left[j]], k)
            left = left[~done]
        for j in left:
            out[j] = self._resolve(np.arange(n), queries[j], own[j], k)
        return out

    def _resolve(self, rows: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != own]
        kind = _kind(self.x[rows], query)
        scores = (self.x[rows].astype(kind) @ query.astype(kind)).astype(np.int64)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int, batch: int = 256):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if candidates.num_rows == 0 or queries.num_rows == 0:
            return _OUT.empty_table()
        width = max(int(np.max(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False), initial=0)) for t in (candidates, queries))
        lists = SortedLists(candidates.column("id").to_numpy(), _matrix(candidates.column("v"), width))
        own, q = queries.column("id").to_numpy(), _matrix(queries.column("v"), width)
        parts = []
        for at in range(0, len(own), batch):
            for i, (rows, scores) in zip(own[at : at + batch], lists.top(q[at : at + batch], own[at : at + batch], k), strict=True):
                parts.append((np.full(len(rows), i), lists.ids[rows], scores))
        return pa.Table.from_arrays([pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in range(3)], schema=_OUT)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """queries, candidates: (id long, v array<long>). query_id, rank, vec_id, score of the k highest inner products."""
    queries, candidates = staged(queries.where("v is not null"), "queries"), staged(candidates.where("v is not null"), "vectors")
    n, m = (max(1, math.ceil(t.count() / size)) for t, size in ((candidates, shard), (queries, block)))
    deal = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = candidates.withColumn("shard", deal(n)).withColumn("block", each(m))
    right = queries.withColumn("block", deal(m)).withColumn("shard", each(n))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(rows.where("id % 20 = 0"), rows.where("id is not null"))
