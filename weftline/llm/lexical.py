"""Ranked lexical search over a two-level quantised index.

The index of a set of queries holds, block by block of documents, the postings of the queries' terms. Its first level is
a byte for each posting: the impact of the term on the document, rounded up. Its second level is what the impact is made
of, exactly: occurrences, and a number for the document's length. A search adds up bytes for all queries and documents of
a block. The sum bounds a document's score from above and, less one unit of every term, from below. Documents whose upper
bound reaches the k-th largest lower bound (or the k-th exact score so far) are scored again from the second level in
whole numbers, and the best of all tasks are merged.

Defined cases: null and empty texts, and those without a term, take no part, neither as documents nor in counts; repeated
document rows each count as a document; rows that share an item_id are one item with all their terms, also a null one; an
item without terms, and empty tables, give no rows; equal scores go to the smaller doc_id, a null one last; other columns
are ignored; documents and items may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import LOWER, map_arrow, text_bytes, word_spans
from weftline.storage import discard, materialize

#: What is between terms: ASCII other than digits and letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False

#: An impact is below 10^6; a byte stands for so much of it, rounded up.
UNIT = 3922
#: Postings added up at a time.
_PART = 1 << 20
_LEVELS = "docs array<long>, sizes array<long>, terms array<int>, starts array<int>, places binary, counts binary"


def terms_of(column: pa.Array, between: np.ndarray = _BETWEEN) -> tuple[pa.Array, np.ndarray]:
    """All terms of a string column, lower-cased, one after the other, and the term offsets of rows."""
    data, offsets = text_bytes(column)
    starts, ends, at = word_spans(data, offsets, between)
    joined = LOWER[data[~between[data]]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]), at


def impacts(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m): what a posting counts, by its occurrences and its document's m."""
    return 1_000_000_000 * counts // (1000 * counts + 8 * sizes)


def length_numbers(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m = 10 + (90 n N) div L for documents of n terms; in Python's numbers where 64 bits don't hold the product."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        return 10 + 90 * n * documents // max(terms, 1)
    return np.array([10 + 90 * int(x) * documents // terms for x in n], np.int64)


@dataclass
class Index:
    """The index of a vocabulary: a table of blocks, how many documents there are, and each term's documents."""

    blocks: DataFrame
    documents: int
    frequencies: np.ndarray

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2.0 * self.documents + 2) / (2.0 * int(self.frequencies[term]) + 1)))


def _postings(shared):
    """Blocks of postings by term, from texts; ``sizes`` are numbers of terms."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, at = terms_of(batch.column("text"))
        n = np.diff(at)
        term = pc.index_in(found, value_set=shared.value).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(~np.isnan(term)) if term.dtype.kind == "f" else np.arange(len(term))
        row, rows = np.repeat(np.arange(len(n)), n)[hit], len(n)
        key, counts = np.unique(term[hit].astype(np.int64) * rows + row, return_counts=True)
        term, row = key // max(rows, 1), key % max(rows, 1)
        used, place = np.unique(row, return_inverse=True)
        terms, starts = np.unique(term, return_index=True)
        lists = [batch.column("doc_id").take(pa.array(used)), pa.array(n[used]), pa.array(terms, pa.int32()), pa.array(np.append(starts, len(term)), pa.int32())]
        return pa.RecordBatch.from_arrays(
            [pa.array([x.to_pylist()], pa.list_(x.type)) for x in lists]
            + [pa.array([place.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])],
            names=["docs", "sizes", "terms", "starts", "places", "counts", "n_docs", "n_terms"],
        )

    return run


def _totals(width: int):
    """Documents by term, then the numbers of documents and of terms, of a partition's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 2, np.int64)
        for batch in batches:
            for terms, starts, docs, n in zip(batch.column("terms"), batch.column("starts"), batch.column("n_docs").to_pylist(), batch.column("n_terms").to_pylist(), strict=True):
                total[terms.values.to_numpy()] += np.diff(starts.values.to_numpy())
                total[width:] += (docs, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "value"])

    return run


def _quantised(documents: int, terms: int):
    """Blocks with numbers for lengths instead of lengths, and with the bytes of the first level."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, level = [], []
        for row in range(batch.num_rows):
            m = length_numbers(batch.column("sizes")[row].values.to_numpy(), documents, terms)
            places, counts = (np.frombuffer(batch.column(c)[row].as_py(), kind).astype(np.int64) for c, kind in (("places", np.uint16), ("counts", np.uint32)))
            sizes.append(m)
            level.append((-(-impacts(counts, m[places]) // UNIT)).astype(np.uint8).tobytes())
        return pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("docs", "terms", "starts", "places", "counts")} | {"sizes": pa.array(sizes, pa.list_(pa.int64())), "impacts": pa.array(level, pa.binary())}).select(
            ["docs", "sizes", "terms", "starts", "places", "counts", "impacts"]
        )

    return run


def build(documents: DataFrame, vocabulary: list[bytes], block_rows: int = 1024) -> Index:
    """The index of the terms in ``vocabulary`` over all documents; at most 65536 documents in a block."""
    shared = documents.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.large_binary()))
    raw = map_arrow(documents.select("doc_id", "text").where(F.length("text") > 0), _postings(shared), f"{_LEVELS}, n_docs long, n_terms long", block_rows)
    raw = materialize(raw, "lexical-postings")
    shared.destroy()
    width = len(vocabulary)
    total = np.zeros(width + 2, np.int64)
    for r in raw.select("terms", "starts", "n_docs", "n_terms").mapInArrow(_totals(width), "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r["value"]
    n_docs, n_terms = (int(x) for x in total[width:])
    blocks = materialize(map_arrow(raw.where(F.size("docs") > 0).drop("n_docs", "n_terms"), _quantised(n_docs, n_terms), f"{_LEVELS}, impacts binary", 16), "lexical-index")
    discard(raw)
    return Index(blocks, n_docs, total[:width])


class Search:
    """The best k so far of each query, over blocks that come one by one."""

    def __init__(self, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, queries: int, k: int):
        """owner, terms, weights: a row for each term of each query, by query."""
        self.owner, self.terms, self.weights, self.k, self.queries = owner, terms, weights, k, queries
        self.least = np.zeros(queries, np.int64)  # scores below this don't enter
        self.best = [np.zeros(0, np.int64) for _ in range(4)]  # query, score, whether doc_id is null, doc_id
        self.scored = 0

    def add(self, docs: pa.Array, sizes: np.ndarray, terms: np.ndarray, starts: np.ndarray, places: np.ndarray, counts: np.ndarray, level: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        there = np.flatnonzero(terms[at] == self.terms)
        at, owner, weight = at[there], self.owner[there], self.weights[there]
        n = starts[at + 1] - starts[at]
        none = docs.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = docs.fill_null(0).to_numpy()
        # Whole queries at a time, of about _PART postings together.
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(n)])
        cut = first[np.unique(before[first] // _PART, return_index=True)[1]]
        for a, b in zip(cut, np.append(cut[1:], len(owner)), strict=True):
            self._part(owner[a:b], weight[a:b], starts[at[a:b]], n[a:b], ids, none, sizes, places, counts, level)

    def _part(self, owner, weight, start, n, ids, none, sizes, places, counts, level) -> None:
        query, which = np.unique(owner, return_inverse=True)
        posting = np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        width, w = len(ids), np.repeat(weight, n)
        cell = np.repeat(which * width, n) + places[posting]
        # Sums stay below 2^53, where floating point is exact: 255 times the weights of an item's terms.
        upper = np.bincount(cell, w * level[posting].astype(np.float64), len(query) * width).astype(np.int64).reshape(len(query), width)
        least = self.least[query]
        if width >= self.k:
            slack = np.bincount(which, weight, len(query)).astype(np.int64)  # one unit of every term
            kth = np.partition(upper, width - self.k, 1)[:, width - self.k]
            least = np.maximum(least, UNIT * (kth - slack))
        reach = (upper * UNIT >= np.maximum(least, 1)[:, None]).ravel()
        chosen = np.flatnonzero(reach[cell])
        exact = np.zeros(len(query) * width, np.int64)
        posting = posting[chosen]
        np.add.at(exact, cell[chosen], w[chosen] * impacts(counts[posting], sizes[places[posting]]))
        found = np.flatnonzero(reach)
        self.scored += len(found)
        found = found[exact[found] >= np.maximum(self.least[query], 1)[found // width]]
        place = found % width
        self._merge(query[found // width], exact[found], none[place], ids[place])

    def _merge(self, query, score, none, ids) -> None:
        new = [np.concatenate(x) for x in zip(self.best, (query, score, none, ids), strict=True)]
        order = np.lexsort((new[3], new[2], -new[1], new[0]))
        q = new[0][order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        self.best = [x[order] for x in new]
        full = self.best[0][self.k - 1 :] == self.best[0][: len(order) - self.k + 1] if len(order) >= self.k else np.zeros(0, bool)
        last = np.flatnonzero(full) + self.k - 1
        self.least[self.best[0][last]] = self.best[1][last]

    def rows(self) -> pa.RecordBatch:
        query, score, none, ids = self.best
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])


def _best(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, terms, weights, queries = shared.value
        search = Search(owner, terms, weights, queries, k)
        for batch in batches:
            for row in range(batch.num_rows):
                docs, sizes, own, starts = (batch.column(c)[row].values for c in ("docs", "sizes", "terms", "starts"))
                places, counts, level = (np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in (("places", np.uint16), ("counts", np.uint32), ("impacts", np.uint8)))
                search.add(docs, sizes.to_numpy(), own.to_numpy(), starts.to_numpy().astype(np.int64), places, counts.astype(np.int64), level)
        yield search.rows()

    return run


def _query_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    found, at = terms_of(batch.column("text"))
    names = batch.column("item_id").take(pa.array(np.repeat(np.arange(len(at) - 1), np.diff(at))))
    return pa.RecordBatch.from_arrays([names, found.cast(pa.binary())], names=["item_id", "term"])


def search(documents: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = 8_000_000) -> DataFrame:
    """Per item and rank: item_id, rank, doc_id, score, for the k documents of highest score above 0.

    ``shard_bytes`` bounds the terms of the items that are indexed and sent to tasks at a time. A larger set of items is
    worked off in several passes over the documents; an item is never parted.
    """
    spark, kind = documents.sparkSession, items.schema["item_id"].dataType.simpleString()
    wanted = materialize(map_arrow(items.select("item_id", "text").where(F.length("text") > 0), _query_terms, f"item_id {kind}, term binary", 256).distinct(), "lexical-items")
    size = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    found = None
    for shard in range(shards):
        some = wanted if shards == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        rows = some.collect()  # of a shard, whose size is bounded
        names, vocabulary = list(dict.fromkeys(r["item_id"] for r in rows)), sorted({bytes(r["term"]) for r in rows})
        number, place = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(vocabulary)}
        pairs = np.array(sorted((number[r["item_id"]], place[bytes(r["term"])]) for r in rows), np.int64).reshape(-1, 2)
        index = build(documents, vocabulary)
        weight = np.array([index.weight(t) for t in range(len(vocabulary))], np.int64)
        shared = spark.sparkContext.broadcast((pairs[:, 0], pairs[:, 1], weight[pairs[:, 1]], len(names)))
        best = index.blocks.mapInArrow(_best(shared, k), "query long, doc_id long, score long")
        listed = spark.createDataFrame([*enumerate(names)], f"number long, item_id {kind}")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = best.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(listed), F.col("query") == F.col("number")).select("item_id", "rank", "doc_id", "score")
        if shards > 1:
            ranked = materialize(ranked, "lexical-found")
            discard(index.blocks)
            shared.destroy()
        found = ranked if found is None else found.unionByName(ranked)
    return found
