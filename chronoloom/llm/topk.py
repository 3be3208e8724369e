"""Exact top-k search by inner product, block at a time."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value

#: Documents of a block: a range of document numbers with the extremes of each term.
BLOCK = 256
#: About how many documents and queries meet in one task.
SHARD_ROWS, GROUP_ROWS = 8192, 2048


def usable(vector: str | Column) -> Column:
    """Whether a vector is not null and has only finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vector: str | Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component x, taken as double."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    lists = vectors.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(vectors: pa.ChunkedArray) -> int:
    return int(max((np.diff(c.offsets.to_numpy()).max(initial=0) for c in vectors.chunks), default=0))


class Blocks:
    """Forward index of some documents in ranges of their numbers, with the least and the greatest value of each term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.edges = np.append(np.arange(0, len(ids), BLOCK), len(ids))
        self.most = np.maximum.reduceat(self.vectors, self.edges[:-1], axis=0)
        self.least = np.minimum.reduceat(self.vectors, self.edges[:-1], axis=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, document number, score) of the k best documents of each query but itself, ties to smaller numbers.

        Each query takes the blocks in order of their bound, the sum of the greatest products of its terms, and stops when the
        bound is below its k-th score. Queries at the same block are scored together.
        """
        size = max(int(abs(queries).max(initial=0)), 1) * max(int(abs(self.vectors).max(initial=0)), 1) * max(queries.shape[1], 1)
        kind = np.float32 if size < 2 ** 24 else np.float64 if size < 2 ** 53 else np.int64
        wide = np.float64 if kind is np.int64 else kind
        q, docs = queries.astype(kind), self.vectors.astype(kind)
        up, down = np.maximum(queries, 0).astype(wide), np.minimum(queries, 0).astype(wide)
        bound = (up @ self.most.T.astype(wide) + down @ self.least.T.astype(wide)).astype(np.float64)
        if kind is np.int64:
            bound += np.abs(bound) * 1e-9 + 1
        order, n = np.argsort(-bound, axis=1), len(queries)
        scores = np.full((n, k), np.iinfo(np.int64).min)
        found = np.full((n, k), np.iinfo(np.int64).max)
        alive = np.arange(n)
        for step in range(bound.shape[1]):
            block = order[alive, step]
            going = bound[alive, block] >= scores[alive, k - 1]
            alive, block = alive[going], block[going]
            if not len(alive):
                break
            for b in np.unique(block):
                self._score(alive[block == b], slice(self.edges[b], self.edges[b + 1]), q, docs, query_ids, scores, found)
        row, at = np.nonzero(found != np.iinfo(np.int64).max)
        return row, found[row, at], scores[row, at]

    def _score(self, rows: np.ndarray, part: slice, q: np.ndarray, docs: np.ndarray, query_ids: np.ndarray,
               scores: np.ndarray, found: np.ndarray) -> None:
        k, ids = scores.shape[1], self.ids[part]
        own = (q[rows] @ docs[part].T).astype(np.int64)
        own[query_ids[rows][:, None] == ids] = np.iinfo(np.int64).min
        some = own.max(axis=1) >= scores[rows, k - 1]
        rows, own = rows[some], own[some]
        numbers = np.where(own == np.iinfo(np.int64).min, np.iinfo(np.int64).max, ids)
        both, named = np.concatenate([scores[rows], own], axis=1), np.concatenate([found[rows], numbers], axis=1)
        best = np.lexsort((named, -both.astype(np.float64) if abs(both[both > np.iinfo(np.int64).min]).max(initial=0) < 2 ** 53
                           else ~both), axis=1)[:, :k]
        scores[rows], found[rows] = np.take_along_axis(both, best, axis=1), np.take_along_axis(named, best, axis=1)


def top_k(queries: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k documents of greatest inner product of every query, exactly.

    ``queries`` (query_id, v array<long>), ``docs`` (vec_id, v array<long>); a document with the query's id is its own. Missing
    components count as 0; scores have to fit a long. A query id with several vectors stands for the smallest of them; documents that repeat id and
    vector are one; other vectors of an id are documents of their own. Rows without an id take no part. Fewer than k
    documents: all. Empty tables: no rows.

    Documents are dealt into shards of about SHARD_ROWS and queries into groups of about GROUP_ROWS rows, whose numbers follow
    the counts; each pair of shard and group is a task of bounded size that returns k rows a query.
    """
    by_value()
    docs = docs.where("vec_id IS NOT NULL").dropDuplicates(["vec_id", "v"])
    queries = queries.where("query_id IS NOT NULL").groupBy("query_id").agg(F.min("v").alias("v"))
    shards = max(1, math.ceil(docs.count() / SHARD_ROWS))
    groups = max(1, math.ceil(queries.count() / GROUP_ROWS))

    def dealt(df: DataFrame, id_col: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), "v", F.pmod(F.xxhash64(id_col, "v"), F.lit(n)).alias(own),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        width = max(_width(left["v"]), _width(right["v"]))
        query_ids = left["id"].to_numpy()
        blocks = Blocks(right["id"].to_numpy(), _matrix(right["v"], width))
        row, ids, scores = blocks.search(query_ids, _matrix(left["v"], width), k)
        return pa.table([query_ids[row], ids, scores], names=names)

    left = dealt(queries, "query_id", "part", groups, "shard", shards).groupBy("shard", "part")
    right = dealt(docs, "vec_id", "shard", shards, "part", groups).groupBy("shard", "part")
    near = left.cogroup(right).applyInArrow(task, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
