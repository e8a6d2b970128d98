"""Language identification by a convolutional network over bytes.

A filter of width w has a weight for every byte at each of its w places (a convolution over one-hot bytes). The
responses of all filters are max-pooled over a window of fixed length and a softmax layer names the language. The
network is trained in numpy on the driver, on a bounded sample of labelled rows, and applied to batches of windows that
together cover every whole text; a document gets the language of the highest mean log-probability, weighted by length.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is everything if no row is labelled;
an empty table gives an empty result; of languages with equal scores the first in order of name is taken; repeated rows
give repeated results; other columns are ignored; a null doc_id is held out from learning; very long texts are worked
off in blocks of windows, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import text_bytes

WIDTHS = (2, 3, 4)
WINDOW = 256
_STEP = WINDOW - max(WIDTHS) + 1


def held_out() -> Column:
    """Rows that no model learns from: crc32 of the decimal doc_id is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


class ByteCNN:
    """Max-pooled byte filters and a softmax layer, with Adam."""

    def __init__(self, classes: list[str], filters: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.filters = classes, filters
        self.p = {f"w{w}": rng.normal(0, 0.4, (w, 256, filters)).astype(np.float32) for w in WIDTHS}
        self.p["out"] = rng.normal(0, 0.2, (len(WIDTHS) * filters, len(classes))).astype(np.float32)
        self.p["bias"] = np.zeros(len(classes), np.float32)

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled responses (n, filters of all widths) and where each maximum is. x: (n, WINDOW) bytes."""
        pooled, where = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            response = sum(self.p[f"w{w}"][k][x[:, k : k + n]] for k in range(w))
            at = response.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
        return np.concatenate(pooled, 1), where

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 11) -> ByteCNN:
        """windows: (n, WINDOW) bytes. Parts of windows are blanked at random, so that short texts are learned too."""
        rng = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                x, y = windows[rows].copy(), labels[rows]
                size = np.where(rng.random(len(rows)) < 0.5, WINDOW, rng.integers(12, WINDOW, len(rows)))
                x[np.arange(WINDOW)[None, :] >= size[:, None]] = 0
                pooled, where = self._pool(x)
                hidden = np.tanh(pooled)
                z = hidden @ self.p["out"] + self.p["bias"]
                z = np.exp(z - z.max(1, keepdims=True))
                d = z / z.sum(1, keepdims=True)
                d[np.arange(len(y)), y] -= 1
                d /= len(y)
                grad = {"out": hidden.T @ d + 1e-4 * self.p["out"], "bias": d.sum(0)}
                back = (d @ self.p["out"].T) * (1 - hidden**2)
                for i, w in enumerate(WIDTHS):
                    part, f = back[:, i * self.filters : (i + 1) * self.filters].ravel(), np.arange(self.filters)
                    cells = [(np.take_along_axis(x, where[i] + k, 1).astype(np.int64) * self.filters + f).ravel() for k in range(w)]
                    grad[f"w{w}"] = np.stack([np.bincount(c, part, 256 * self.filters).reshape(256, -1) for c in cells]).astype(np.float32)
                t += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    step = rate * (1 - t / (steps + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                    self.p[k] -= (step * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> list[tuple[int, np.ndarray, np.ndarray | None, bool]]:
        """For each width the responses to byte pairs, so that a filter costs a lookup for every two of its places."""
        out = []
        for w in WIDTHS:
            p = self.p[f"w{w}"]
            first = (p[0][:, None, :] + p[1][None, :, :]).reshape(65536, -1)
            second = None if w == 2 else p[2] if w == 3 else (p[2][:, None, :] + p[3][None, :, :]).reshape(65536, -1)
            out.append((w, np.ascontiguousarray(first), second, w == 4))
        return out


class Scorer:
    """Applies a network to windows of bytes, some hundred at a time."""

    def __init__(self, model: ByteCNN):
        self.classes, self.tables, self.out, self.bias = model.classes, model.tables(), model.p["out"], model.p["bias"]

    def log_probabilities(self, windows: np.ndarray, at_a_time: int = 64) -> np.ndarray:
        """windows: (n, WINDOW) bytes."""
        logs = np.empty((len(windows), len(self.classes)), np.float32)
        for at in range(0, len(windows), at_a_time):
            x = np.ascontiguousarray(windows[at : at + at_a_time].T).astype(np.int32)  # places first: pooling runs over rows
            pairs = x[:-1] * 256 + x[1:]
            pooled = []
            for w, first, second, is_pair in self.tables:
                n = WINDOW - w + 1
                response = first.take(pairs[:n].ravel(), 0)
                if second is not None:
                    response += second.take((pairs[2 : 2 + n] if is_pair else x[2 : 2 + n]).ravel(), 0)
                pooled.append(response.reshape(n, -1).max(0).reshape(x.shape[1], -1))
            z = np.tanh(np.concatenate(pooled, 1)) @ self.out + self.bias
            z -= z.max(1, keepdims=True)
            logs[at : at + at_a_time] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return logs


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover all rows' bytes: (n, WINDOW) bytes with zeros after a row's end, their rows and lengths."""
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(-(-(sizes - WINDOW) // _STEP) + 1, 1), 0)
    rows = np.repeat(np.arange(len(sizes)), counts)
    ordinal = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][rows] + ordinal * _STEP
    lengths = np.minimum(offsets[1:][rows] - starts, WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts].copy() if len(starts) else np.zeros((0, WINDOW), np.uint8)
    windows[np.arange(WINDOW)[None, :] >= lengths[:, None]] = 0
    return windows, rows, lengths


def predict_texts(scorer: Scorer | None, column: pa.Array, slice_rows: int = 256) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for at in range(0, len(column), slice_rows):
        part = column.slice(at, slice_rows)
        letters = [t is not None and any(map(str.isalpha, t)) for t in part.to_pylist()]
        if scorer is None or not any(letters):
            names += ["und"] * len(part)
            scores += [0.0] * len(part)
            continue
        data, offsets = text_bytes(part)
        total = np.zeros((len(part), len(scorer.classes)))
        weight = np.zeros(len(part))
        # Windows of a block of bytes at a time: a very long text needs no more memory than a short one.
        windows, rows, lengths = cut_windows(data, offsets) if len(data) < 1 << 22 else (None, None, None)
        blocks = [(windows, rows, lengths)] if windows is not None else _blocks(data, offsets)
        for windows, rows, lengths in blocks:
            np.add.at(total, rows, scorer.log_probabilities(windows) * lengths[:, None])
            np.add.at(weight, rows, lengths)
        mean = total / np.maximum(weight, 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        names += [scorer.classes[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
        scores += [float(p[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters, strict=True))]
    return names, scores


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``cut_windows``, but for at most 4096 windows at a time."""
    for row, (start, end) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        span = 4096 * _STEP
        for at in range(int(start), int(end), span):
            piece = data[at : min(at + span + WINDOW - _STEP, int(end))]
            windows, rows, lengths = cut_windows(piece, np.array([0, len(piece)]))
            yield windows, rows + row, lengths


def all_windows(text: bytes) -> list[bytes]:
    """The windows that cover a text."""
    count = max(-(-(len(text) - WINDOW) // _STEP) + 1, 1) if text else 0
    return [text[j * _STEP : j * _STEP + WINDOW].ljust(WINDOW, b"\0") for j in range(count)]


def train(documents: DataFrame, sample_rows: int = 2000, epochs: int = 6) -> ByteCNN | None:
    """A network for all languages of labelled rows that aren't held out, or None without such rows.

    It is fitted on at most ``sample_rows`` rows (but one of each language at least), shared out equally between the
    languages and chosen by a hash of doc_id, and on all windows of their texts. Nothing else is bounded.
    """
    labelled = documents.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).toPandas().set_index("lang")["n"].to_dict()  # the classes
    if not counts:
        return None
    quota = max(1, sample_rows // len(counts))
    shares = documents.sparkSession.createDataFrame([(k, min(1.0, (1.3 * quota + 30) / n)) for k, n in counts.items()], "lang string, share double")
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.withColumn("u", u).join(F.broadcast(shares), "lang").where("u < share")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_windows(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.select(["lang", "u", "doc_id"]).columns, pa.array(found, pa.list_(pa.binary()))], names=["lang", "u", "doc_id", "pieces"])

    # A few more rows than the quota of each language are left, so that no language is a large group.
    cut_rows = chosen.select("lang", "u", "doc_id", "text").mapInArrow(cut, "lang string, u double, doc_id long, pieces array<binary>")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "pieces"))
    rows = cut_rows.withColumn("rank", rank).where(F.col("rank") <= quota).select("lang", "u", "doc_id", "pieces").collect()
    classes = sorted(counts)
    place = {k: i for i, k in enumerate(classes)}
    pieces = [(place[r["lang"]], bytes(x)) for r in sorted(rows) for x in r["pieces"]]
    windows = np.frombuffer(b"".join(x for _, x in pieces), np.uint8).reshape(-1, WINDOW)
    return ByteCNN(classes).fit(windows, np.array([k for k, _ in pieces]), epochs=epochs)


def identify(documents: DataFrame, model: ByteCNN | None = None, sample_rows: int = 2000) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score. Without ``model`` one is trained on the same documents."""
    model = model or train(documents, sample_rows)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            names, scores = predict_texts(scorer, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")
