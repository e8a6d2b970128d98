"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors of integers are kept in blocks of consecutive ids: a block's forward index is its ids and its matrix, and its
summary is the largest and smallest value of each term (component). For a query, the sum over terms of the larger of
value * largest and value * smallest bounds every score in a block. Each task orders its blocks by that bound, for each
query, and scores block after block until the bounds fall below the query's k-th best score so far; then nothing behind
can enter. The best of all tasks are merged by score and id.

Defined cases: null vectors and those with null or non-finite components take no part, neither do null ids; vectors of
other length count as filled up with zeros, whatever their length; equal scores go to the smaller id; an empty table
gives an empty result; scores are exact whole numbers, and values for which one could exceed 64 bits raise an error; repeated candidate rows each count as a
candidate, repeated query ids as one query (of the smallest vector); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.storage import materialize


_EXACT = float(1 << 53)
_LEAST = np.iinfo(np.int64).min


def quantized(lists: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each list, as rows of int64."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(values) and np.abs(values).max() >= 2.0**63:
        raise OverflowError("a component is beyond 64 bits")
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.astype(np.int64)
    return out


class Search:
    """The best k so far of each query, over blocks that come group by group."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.norm = np.abs(vectors.astype(np.float64)).sum(1).max(initial=0)
        self.exact_vectors = vectors
        self.vectors = vectors.astype(np.float64)
        self.score = np.full((len(ids), k), _LEAST)
        self.best = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.scored = 0

    def add(self, blocks: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """blocks: (ids, matrix of int64) each, ids ascending."""
        largest = max(float(np.abs(m.astype(np.float64)).max(initial=0)) for _, m in blocks) * self.norm
        if largest >= 2.0**63:
            raise OverflowError("a score may be beyond 64 bits")
        # Below 2^53 sums are exact in floating point, and fast; beyond, whole numbers are used and bounds get room.
        exact = largest < _EXACT
        high = np.stack([m.max(0) for _, m in blocks]).astype(np.float64)
        low = np.stack([m.min(0) for _, m in blocks]).astype(np.float64)
        bounds = np.maximum(self.vectors, 0) @ high.T + np.minimum(self.vectors, 0) @ low.T
        if not exact:
            bounds += largest * 2.0**-40
        order = np.argsort(-bounds, 1, kind="stable")
        for turn in range(len(blocks)):
            at = order[:, turn]
            live = np.flatnonzero(bounds[np.arange(len(at)), at] >= self.score[:, -1])
            if not len(live):
                break
            for b in np.unique(at[live]):
                self._score(live[at[live] == b], *blocks[b], exact)

    def _score(self, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, exact: bool) -> None:
        self.scored += len(queries) * len(ids)
        scores = (self.vectors[queries] @ matrix.T.astype(np.float64)).astype(np.int64) if exact else self.exact_vectors[queries] @ matrix.T
        last, last_id = self.score[queries, -1][:, None], self.best[queries, -1][:, None]
        enters = ((scores > last) | (scores == last) & (ids[None, :] < last_id)) & (ids[None, :] != self.ids[queries][:, None])
        row, column = np.nonzero(enters)
        if not len(row):
            return
        touched = np.unique(row)
        place = np.repeat(touched, self.k)
        q = np.concatenate([place, row])
        s = np.concatenate([self.score[queries[touched]].ravel(), scores[row, column]])
        i = np.concatenate([self.best[queries[touched]].ravel(), ids[column]])
        order = np.lexsort((i, ~s, q))  # ~s is -1 - s, which doesn't overflow
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.score[queries[q[keep]], rank[keep]] = s[keep]
        self.best[queries[q[keep]], rank[keep]] = i[keep]

    def rows(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.best < np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[query]), pa.array(self.best[query, place]), pa.array(self.score[query, place])],
            names=["query_id", "vec_id", "score"],
        )


def _blocks(width: int, scale: float, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, matrix = batch.column("vec_id").to_numpy(), quantized(batch.column("embedding"), width, scale)
            parts = range(0, len(ids), rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[a : a + rows].tobytes() for a in parts], pa.binary()), pa.array([matrix[a : a + rows].tobytes() for a in parts], pa.binary())],
                names=["ids", "matrix"],
            )

    return run


def _best(shared, width: int, k: int, group: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        search = Search(ids, vectors, k)
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                search.add([(np.frombuffer(i.as_py(), np.int64), np.frombuffer(m.as_py(), np.int64).reshape(-1, width)) for i, m in zip(part.column("ids"), part.column("matrix"), strict=True)])
        yield search.rows()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block_rows: int = 256, query_bytes: int = 16 << 20) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score. Both tables have vec_id and embedding.

    Queries go to the tasks in chunks of at most ``query_bytes``; each chunk is a pass over the blocks.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    valid = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
    vectors = vectors.where(valid).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.where(valid).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "query_id long, vec_id long, score long"
    width = max(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0, queries.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    index = materialize(vectors.sortWithinPartitions("vec_id").mapInArrow(_blocks(width, scale, block_rows), "ids binary, matrix binary"), "topk-blocks")
    # One vector for each query id, each in one of the chunks, so that a chunk reads its own rows only.
    chunks = max(1, -(-queries.count() * width * 8 // query_bytes))
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    queries = materialize(queries.repartitionByRange("chunk").sortWithinPartitions("chunk"), "topk-queries")
    found = None
    for c in range(chunks):
        rows = sorted((r["vec_id"], r["embedding"]) for r in queries.where(F.col("chunk") == c).collect())
        ids = np.array([i for i, _ in rows], np.int64)
        matrix = quantized(pa.array([x for _, x in rows], pa.list_(pa.float64())), width, scale)
        shared = spark.sparkContext.broadcast((ids, matrix))
        best = index.mapInArrow(_best(shared, width, k), schema)
        if chunks > 1:
            best = materialize(_ranked(best, k).drop("rank"), "topk-chunk")
            shared.destroy()
        found = best if found is None else found.unionByName(best)
    return _ranked(found, k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """The 5 best other vectors of every vector whose id is divisible by 50."""
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
