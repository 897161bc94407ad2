"""Exact top-k inner products by no-random-access aggregation of sorted lists.

The vectors of a block give one sorted list for each component, read from the
top for queries whose component is positive and from the bottom where it is
negative. All lists are read sequentially to the same depth, round by round.
What has been read gives each vector a lower bound (unread components count
their list's worst value) and an upper bound (unread components count the last
value read). Reading stops for a query when the vectors whose upper bound
reaches its k-th lower bound are few; their final scores are then resolved and
no outsider can qualify. The best of all blocks are merged by rank.

Queries come in blocks too: each block of vectors meets each block of queries
once, by a join on the number of the query block.

Defined results: components are turned into floor(scale * x), computed in
double precision. Vectors that are null, empty, or hold a null or non-finite
component, and rows with a null vec_id, take no part. Rows with a query's
vec_id aren't candidates of it. Only vectors of equal length are compared. Ties
go to the smaller vec_id, then in any order. Rows that repeat a query are
queries of their own. Scores beyond a signed 64-bit integer are cut to its
range. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.llm.batches import bound_batches
from evalmill.session import stage

BLOCK = 4096
QUERY_BLOCK = 512
#: Depths of the rounds, as shares of the lists.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)
#: Scores up to here are exact in double precision, and so are their bounds.
EXACT = float(1 << 52)


def usable_rows(batch: pa.RecordBatch, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, scaled vectors) of a batch by length, without the rows that take no part."""
    lists = batch.column("embedding")
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    starts = np.cumsum(sizes) - sizes
    broken = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = (sizes > 0) & (broken[starts + sizes] == broken[starts])
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(sizes[good]).tolist():
        chosen = np.flatnonzero(good & (sizes == dim))
        out[dim] = ids[chosen].astype("<i8"), np.floor(scale * flat[starts[chosen][:, None] + np.arange(dim)])
    return out


def blocks_of(vectors: DataFrame, scale: float, rows: int) -> DataFrame:
    """Blocks (dim, ids, matrix) of at most ``rows`` usable vectors; binary, little-endian."""
    bound_batches(vectors.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            parts = held.get(dim, [])
            while sum(len(i) for i, _ in parts) >= least:
                ids, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
                row = [dim], [ids[:rows].tobytes()], [matrix[:rows].astype("<f8").tobytes()]
                yield pa.record_batch([pa.array(c) for c in row], names=["dim", "ids", "matrix"])
                parts[:] = [(ids[rows:], matrix[rows:])] if len(ids) > rows else []

        for batch in batches:
            for dim, found in usable_rows(batch, scale).items():
                held.setdefault(dim, []).append(found)
                yield from packed(dim, rows)
        for dim in held:
            yield from packed(dim, 1)

    usable = vectors.filter("vec_id is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return usable.mapInArrow(each, "dim long, ids binary, matrix binary")


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if np.abs(query).max(initial=0) * np.abs(vectors).max(initial=0) * len(query) < EXACT:
        return (vectors @ query).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(query.tolist(), v, strict=True)) for v in vectors.tolist()]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in whole], np.int64)


class SortedLists:
    """The sorted lists of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(ids))[:, None], axis=0)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x vectors) after reading ``depth`` entries of each list."""
        n = len(self.ids)
        from_top, from_bottom = self.rank >= n - depth, self.rank < depth
        least, most = self.sorted[0], self.sorted[-1]
        signs = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
        read = lambda high, low: np.hstack(
            [np.where(from_top, self.vectors, high), np.where(from_bottom, self.vectors, low)]
        )
        return signs @ read(least, most).T, signs @ read(self.sorted[n - depth], self.sorted[depth - 1]).T

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(vec_ids, scores) of each query's best k of this block, in order."""
        n = len(self.ids)
        found: list = [None] * len(queries)
        todo = np.arange(len(queries))
        if np.abs(queries).max() * np.abs(self.vectors).max() * queries.shape[1] >= EXACT:
            return [self._resolve(q, v, np.flatnonzero(self.ids != q), k) for q, v in zip(query_ids, queries, strict=True)]
        few = max(8 * k, 64)
        for share in DEPTHS:
            depth = max(1, min(n, round(share * n)))
            low, high = self.bounds(queries[todo], depth)
            own = self.ids == query_ids[todo][:, None]
            low[own] = high[own] = -np.inf
            bar = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(todo), -np.inf)
            inside = (high >= bar[:, None]) & ~own
            ended = (inside.sum(1) <= few) | (depth == n)
            for at in np.flatnonzero(ended).tolist():
                q = todo[at]
                found[q] = self._resolve(query_ids[q], queries[q], np.flatnonzero(inside[at]), k)
            todo = todo[~ended]
            if not len(todo):
                break
        return found

    def _resolve(self, query_id: int, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores, ids = exact_scores(query, self.vectors[rows]), self.ids[rows]
        top = np.lexsort((ids, -scores.astype(object) if scores.min(initial=0) == -(1 << 63) else -scores))[:k]
        return ids[top], scores[top]


def top_k(
    vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row that ``queries`` picks."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = stage(blocks_of(vectors.filter(queries).repartition(1 + parts // 8), scale, query_block), "query-blocks")
    asked = stage(asked.withColumn("number", F.monotonically_increasing_id()), "query-blocks-numbered")
    # Few query blocks are dealt out to as many tasks as there are partitions, each with part of the vectors.
    salts = max(1, parts // max(1, asked.count()))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    numbers = asked.select(F.col("number").alias("meets"), F.col("dim").alias("of"))
    blocks = blocks_of(vectors, scale, block).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    met = blocks.join(numbers, blocks["dim"] == numbers["of"]).select("meets", "part", "ids", "matrix")
    said = asked.select(
        "number", "dim", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"), salt.alias("salt")
    )
    pairs = met.join(said, (met["meets"] == said["number"]) & (met["part"] == said["salt"])).select(
        "number", "dim", "ids", "matrix", "query_ids", "query_matrix"
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, dim, ids, matrix, query_ids, query_matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lists = SortedLists(np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<f8").reshape(-1, dim))
                names = np.frombuffer(query_ids, "<i8")
                best = lists.best(names, np.frombuffer(query_matrix, "<f8").reshape(-1, dim), k)
                sizes = [len(i) for i, _ in best]
                columns = [
                    np.full(sum(sizes), number),
                    np.repeat(np.arange(len(names)), sizes),
                    np.repeat(names, sizes),
                    np.concatenate([i for i, _ in best]),
                    np.concatenate([s for _, s in best]),
                ]
                yield pa.record_batch(
                    [pa.array(c, pa.int64()) for c in columns], names=["number", "place", "query_id", "vec_id", "score"]
                )

    found = pairs.mapInArrow(each, "number long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("number", "place", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )

