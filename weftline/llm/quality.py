"""Quality by a regularised quadratic discriminant over document statistics.

One pass over the texts makes a short vector of statistics for every document: shares of kinds of characters and words,
lengths, and repetition, transformed so that they are roughly normal. Each class has a mean and a covariance of them,
from whole-number sums over all labelled documents that aren't held out; covariances shrink towards the pooled one and
its diagonal. The score is the difference of the two log densities, from Mahalanobis distances by the inverse Cholesky
factors that the model keeps, with the classes' shares as prior.

Defined cases: a null or empty text has the statistics of no characters, and gets a score like any other; repeated rows
give repeated results, and a text is learned once, however often it is there; a text or document that has both labels
counts as label 0; a null doc_id is held out; with labels of one kind only every score is that label, without any it is
0; an empty table gives an empty result; other columns are ignored; very long texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, text_bytes, word_hashes, word_spans
from weftline.llm.langid import held_out
from weftline.storage import materialize

_LOWER, _UPPER, _DIGIT, _SPACE, _PLAIN, _SYMBOL, _BEYOND = range(7)
#: The kind of each byte. Plain marks are those of running prose; bytes beyond ASCII count as letters of words.
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = _LOWER, _UPPER, _DIGIT, _BEYOND
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = _PLAIN

FEATURES = (
    "log_words", "log_word_length", "upper", "digits", "spaces", "plain", "symbols", "beyond_ascii",
    "words_ending_in_symbols", "words_without_letters", "words_with_capitals", "distinct_words", "most_frequent_word", "repeats_of_the_word_before",
)
#: Statistics are whole multiples of 1/1024, so that sums of them and of their products don't depend on the order.
_UNIT = 1024


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The arcsine of the root of a share, whose variance doesn't depend on the share; 0 of nothing."""
    return np.arcsin(np.sqrt(part / np.maximum(whole, 1)))


def statistics(column: pa.Array) -> np.ndarray:
    """A row of whole numbers (int16) for each text."""
    data, offsets = text_bytes(column)
    n, size = len(column), np.diff(offsets)
    kinds = _KIND[data]
    row = np.repeat(np.arange(n), size)
    by_kind = np.bincount(row * 7 + kinds, minlength=7 * n).reshape(n, 7)
    starts, ends, at = word_spans(data, offsets)
    words, of = np.diff(at), np.repeat(np.arange(n), np.diff(at))
    count = lambda hits: np.bincount(of[hits], minlength=n)
    letter = np.concatenate([[0], np.cumsum((kinds == _LOWER) | (kinds == _UPPER) | (kinds == _BEYOND), dtype=np.int64)])
    upper = np.concatenate([[0], np.cumsum(kinds == _UPPER, dtype=np.int64)])
    bare = letter[ends] == letter[starts]
    most = 2 * (upper[ends] - upper[starts]) > ends - starts  # a capital at the beginning isn't most of a word
    hashes = word_hashes(data, starts, ends)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]))
    order = np.lexsort((hashes, of))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    runs = np.flatnonzero(first)
    lengths, frequent = np.diff(np.append(runs, len(order))), np.zeros(n, np.int64)
    np.maximum.at(frequent, of[order[runs]], lengths)
    letters = size - by_kind[:, _SPACE]
    columns = [
        np.log(words + 1.0), np.log((letters + 5.0) / (words + 1.0)),
        *[_share(by_kind[:, k], size) for k in (_UPPER, _DIGIT, _SPACE, _PLAIN, _SYMBOL, _BEYOND)],
        _share(count(kinds[ends - 1] == _SYMBOL), words), _share(count(bare), words), _share(count(most), words),
        np.log((count(order[runs]) + 1.0) / (words + 1.0)), np.log((frequent + 1.0) / (words + 1.0)), _share(count(again), words),
    ]
    return np.clip(np.rint(np.stack(columns, 1) * _UNIT), -32767, 32767).astype(np.int16)


def described(documents: DataFrame) -> DataFrame:
    """A table with a row for each document: doc_id, held_out, key (a hash of the text) and its statistics."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = statistics(batch.column("text"))
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(FEATURES)), len(made), [None, pa.py_buffer(made.tobytes())])
        return pa.RecordBatch.from_arrays([*batch.select(["doc_id", "held_out", "key"]).columns, raw.cast(pa.binary())], names=["doc_id", "held_out", "key", "stats"])

    rows = documents.select("doc_id", held_out().alias("held_out"), F.xxhash64("text").alias("key"), "text")
    return materialize(map_arrow(rows, run, "doc_id long, held_out boolean, key long, stats binary", 512), "quality")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, len(FEATURES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By label: the count, sums and sums of products of a partition's rows, one value a row."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d), np.int64)
    for batch in batches:
        label, x = batch.column("label").to_numpy(), _matrix(batch.column("stats")).astype(np.int64)
        for k in (0, 1):
            some = x[label == k]
            total[k] += np.concatenate([[len(some)], some.sum(0), (some.T @ some).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), 2)), pa.array(total.ravel())], names=["label", "at", "value"])


class Discriminant:
    """Means, inverse Cholesky factors of the covariances, and the constants of both log densities."""

    def __init__(self, means: np.ndarray, inverses: np.ndarray, constants: np.ndarray):
        self.means, self.inverses, self.constants = means, inverses, constants

    @classmethod
    def fit(cls, moments: np.ndarray, floor: float = 0.2) -> Discriminant | None:
        """moments: a row for each label of count, sums and sums of products, in units of the statistics.

        With m parameters in a covariance and n texts, m / (m + n) of it come from the pooled one; ``floor`` of the
        result comes from the pooled diagonal, so that no statistic that hardly varies in a class decides alone.
        """
        d, n = len(FEATURES), moments[:, 0].astype(float)
        if n.min() < 2:
            return None
        means = moments[:, 1 : d + 1] / n[:, None] / _UNIT
        own = [moments[k, d + 1 :].reshape(d, d) / n[k] / _UNIT**2 - np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
        inverses, constants = [], []
        for k in (0, 1):
            shrink = d * (d + 1) / 2 / (d * (d + 1) / 2 + n[k])
            mixed = (1 - shrink) * own[k] + shrink * pooled
            factor = np.linalg.cholesky((1 - floor) * mixed + floor * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d))
            inverses.append(np.linalg.inv(factor))
            constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
        return cls(means, np.stack(inverses), np.array(constants))

    def score(self, stats: np.ndarray) -> np.ndarray:
        x = stats / _UNIT
        density = [c - 0.5 * (((x - m) @ inv.T) ** 2).sum(1) for m, inv, c in zip(self.means, self.inverses, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


def train(stats: DataFrame, labels: DataFrame) -> Discriminant | float:
    """The discriminant of all labelled rows of a table of :func:`described` that aren't held out, or the score that every text
    gets for want of two classes. Only sums come to the driver."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    known = known.groupBy("id").agg(F.min("quality").alias("label"))
    learn = stats.where(~F.col("held_out")).groupBy("doc_id", "key").agg(F.min("stats").alias("stats"))
    texts = learn.join(known, F.col("doc_id") == F.col("id")).groupBy("key").agg(F.min("label").alias("label"), F.min("stats").alias("stats"))
    sums = texts.select("label", "stats").mapInArrow(_moments, "label long, at long, value long").groupBy("label", "at").agg(F.sum("value").alias("value"))
    d = len(FEATURES)
    moments = np.zeros((2, 1 + d + d * d), np.int64)
    for r in sums.collect():
        moments[r["label"], r["at"]] = r["value"]
    model = Discriminant.fit(moments)
    return (1.0 if moments[1, 0] and not moments[0, 0] else 0.0) if model is None else model


def score(stats: DataFrame, model: Discriminant | float, least: float = 0.3) -> DataFrame:
    """Per row of a table of :func:`described`: doc_id, held_out, score, predicted (whether the score reaches ``least``)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, x = shared.value, _matrix(batch.column("stats"))
        scores = known.score(x) if isinstance(known, Discriminant) else np.full(len(x), known)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(stats.select("doc_id", "held_out", "stats"), apply, "doc_id long, held_out boolean, score double, predicted int")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score. Texts are read once: fitting and scoring read their statistics."""
    stats = described(documents)
    return score(stats, train(stats, labels))
