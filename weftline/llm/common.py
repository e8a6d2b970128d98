"""Shared pieces: Arrow helpers and vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.storage import fresh, materialize

#: What an operator keeps in a Python worker between tasks. Others drop it when they run there, so that it doesn't stay
#: in memory beside theirs.
WORKER_CACHES: dict = {}


def drop_caches() -> None:
    """Empty a worker's cache and give memory that earlier tasks have freed back to the system. A function, since a closure
    that is sent to a worker would bring a copy of the dict along."""
    WORKER_CACHES.clear()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]], schema: str | StructType, rows: int = 1024) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so that what is made of long texts stays small in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))
        trim()

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- words

#: White space of the word definition used by the join and the substring operators: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII upper case to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C55)
_PINV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_BLOCK = 1 << 18  # bytes hashed at a time
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_P, _PINV):
            x = np.full(_BLOCK + 1, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x, dtype=np.uint64))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word offsets of rows. A word never crosses rows."""
    inside = ~separator[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        ends_at = offsets[1:][offsets[1:] > 0] - 1
        after[ends_at] = False
        ends = np.flatnonzero(inside & ~after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, taken from running sums, with its length, scrambled."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        if high - low > _BLOCK:  # one word longer than a block
            value = 0
            for byte in bytes(data[low:high][::-1]):
                value = (value * int(_P) + byte + 1) & 0xFFFFFFFFFFFFFFFF
            out[at] = value
        else:
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
            s, e = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = (total[e] - total[s]) * down[s]
        at = stop
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_Q = 0xA0761D6478BD642F


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words (rows ignored: the caller leaves out windows that cross)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = (_Q ^ (seed << 1)) & 0xFFFFFFFFFFFFFFFF
    part = max(_WINDOW_PART, 2 * size)
    up, down = _window_powers(factor, part)
    out = np.empty(n, np.uint64)
    for at in range(0, n, part - size + 1):
        some = words[at : at + part]
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * up[: len(some)], out=total[1:])
        m = len(some) - size + 1
        out[at : at + m] = (total[size:] - total[:m]) * down[:m]
    return mix(out + np.uint64((size * 0x2545F4914F6CDD1D + seed) & 0xFFFFFFFFFFFFFFFF))


_WINDOW_PART = 1 << 14
_WINDOW_POWERS: dict[tuple[int, int], list[np.ndarray]] = {}


def _window_powers(factor: int, n: int) -> list[np.ndarray]:
    """Powers of an odd factor and of its inverse: windows come from running sums."""
    if (factor, n) not in _WINDOW_POWERS:
        powers = []
        for base in (factor, pow(factor, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            powers.append(np.cumprod(x, dtype=np.uint64))
        _WINDOW_POWERS[factor, n] = powers
    return _WINDOW_POWERS[factor, n]


def window_rows(row_words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one row each, and their offsets by row."""
    counts = np.maximum(np.diff(row_words) - size + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(offsets[-1]) + np.repeat(row_words[:-1] - offsets[:-1], counts)
    return starts, offsets


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


# ---------------------------------------------------------------- bitmaps and groups


def bitmap(hashes: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """A Bloom filter (two places a hash) of a column of 64-bit hashes, as 64-bit words.

    Its size is fixed by ``bits``, whatever the column's. It only ever thins out what later, exact steps decide on: if it
    fills up at a larger scale, more rows go through, and results stay the same.
    """
    mask = (1 << bits) - 1
    low = F.expr(f"{column} & {mask}L")
    high = F.expr(f"shiftrightunsigned({column}, 32) & {mask}L")
    places = hashes.select(F.explode(F.array(low, high)).alias("at"))
    words = places.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy().astype(np.int64).view(np.uint64)
    return out


def bitmap_rows(hashes: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """The same filter as rows (word, set), 2^(bits - 6) at most, for :func:`marked`."""
    mask = (1 << bits) - 1
    places = hashes.select(F.explode(F.array(F.expr(f"{column} & {mask}L"), F.expr(f"shiftrightunsigned({column}, 32) & {mask}L"))).alias("at"))
    return materialize(places.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set")), "bitmap")


def marked(df: DataFrame, rows: DataFrame, value: Column, name: str, bits: int = 24) -> DataFrame:
    """``df`` with the boolean ``name``: whether the filter has the hash. The filter's size is fixed, so that it is
    broadcast, and rows are looked up where they are, without Python."""
    mask, out = (1 << bits) - 1, df.withColumn(name, value)
    parts = []
    for place in (F.expr(f"`{name}` & {mask}L"), F.expr(f"shiftrightunsigned(`{name}`, 32) & {mask}L")):
        word, found = fresh(f"{name}_word", out), fresh(f"{name}_set", out)
        at = fresh(f"{name}_at", out)
        out = out.withColumn(at, place)
        out = out.join(F.broadcast(rows.select(F.col("word").alias(word), F.col("set").alias(found))), F.shiftright(at, 6) == F.col(word), "left").drop(word)
        parts.append((found, at))
    hit = [F.expr(f"coalesce((shiftright(`{found}`, cast(`{at}` & 63 as int)) & 1) = 1, false)") for found, at in parts]
    return out.withColumn(name, hit[0] & hit[1]).drop(*[c for part in parts for c in part])


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(words) * 64 - 1)
    found = np.ones(len(hashes), bool)
    for at in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        found &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over all rows of each value of the long column ``key`` together; groups must be small.

    Cheaper than a grouped pandas function where there are very many groups: rows are brought together and sorted by
    Spark, and runs are found on whole Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if held and held[-1].column(key)[0].as_py() != keys[a]:
                    if (out := fn(_one(held))) is not None:
                        yield out
                    held = []
                held.append(part)
        if held and (out := fn(_one(held))) is not None:
            yield out

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], then: Callable[[DataFrame], DataFrame], share: int = 1000) -> DataFrame:
    """The inner join of ``left`` with ``right``, whose column ``n`` tells how many rows of ``left`` have the key, and
    ``then`` of it. Both are tables, not plans.

    Keys with more than one in ``share`` of the rows are ``share`` at most: their rows of ``right``, one a key, are
    broadcast, and rows of ``left`` with such a key aren't shuffled. Other keys are no large groups.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot, names = right.where(F.col("n") > total // share), [F.col(k) for k in keys]
    cold = left.join(F.broadcast(hot.select(*names)), keys, "left_anti").join(right.where(F.col("n") <= total // share).drop("n"), keys)
    return then(left.join(F.broadcast(hot.drop("n")), keys)).unionByName(then(cold))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): the label is one node of the connected component.

    Every node is merged into its smallest neighbour's smallest neighbour, and edges between what is left are merged
    again, until none is left. Nodes are hashes, so that chains of ever smaller neighbours are short. Nothing comes to
    the driver.
    """
    current = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    found = None
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "merge")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = materialize(least.join(up, "label").select("node", F.col("next").alias("label")), "merge")
        left, right = step.select(F.col("node").alias("a"), F.col("label").alias("x")), step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        current = materialize(current.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        further = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = step if found is None else materialize(found.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")) if found is None else found
