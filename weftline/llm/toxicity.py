"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and word beginnings, fitted in numpy on the driver. Besides the labels, it learns from pairs of labelled
sentences that differ only in an identity term: the difference of their scores is penalised, so that the mention of a
group does not by itself raise a score. A word enters the vocabulary by the number of different words around it, not
by how often it occurs, so that a passage copied into many documents doesn't pass for evidence.

Defined cases: a null or empty text gets the score of no words; an empty table gives an empty result; repeated rows give
repeated results and are learned once; a document that has both labels is toxic; other columns are ignored; without
labelled rows of both kinds every score is 0; a null doc_id is held out; very long texts count whole, by their distinct
words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, trim
from weftline.llm.decontaminate import WORD_TABLE, words_of
from weftline.llm.langid import held_out
from weftline.storage import writing

# Identity terms that may take each other's place in a sentence.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("she", "he"),
    ("her", "his"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "citizen", "native"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf", "autistic"),
    ("poor", "rich"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "british"),
)

#: The terms that each may be swapped for.
_SWAPS = {w.encode(): [x.encode() for x in g if x != w] for g in IDENTITY_GROUPS for w in g}
_SENTENCE = re.compile(r"[.!?\n]+")


#: What the fit takes from a text: its distinct words, for each 63 marks of the pairs of words seen around it, and the
#: distinct words of every sentence that has an identity term.
Digest = tuple[list[bytes], list[int], list[list[bytes]]]
_DIGEST = "words array<binary>, marks array<long>, sentences array<array<binary>>"


def digest(text: str) -> Digest:
    marks: dict[bytes, int] = defaultdict(int)
    words = words_of(text)
    for left, word, right in zip([b"", *words], words, [*words[1:], b""], strict=False):
        marks[word] |= 1 << (zlib.crc32(left + b" " + right) % 63)
    sentences = []
    if _SWAPS.keys() & marks.keys():
        sentences = [sorted(found) for x in _SENTENCE.split(text) if _SWAPS.keys() & (found := set(words_of(x)))]
    return [*marks], [*marks.values()], sentences


def counterfactuals(sentences: Iterable[list[bytes]]) -> dict[tuple[frozenset, frozenset], int]:
    """Pairs of the words of a sentence with an identity term and those after a swap for another term of its group, and
    how often each is there."""
    out: Counter = Counter()
    for words, n in Counter(map(frozenset, sentences)).items():
        for term in sorted(_SWAPS.keys() & words):
            for other in _SWAPS[term]:
                out[words, words - {term} | {other}] += n
    return out


#: Word beginnings that are features of their own, in bytes. They are kept apart from words by a star for each different
#: word of the text that begins so, up to ``LEVELS``: by chance one such word turns up in a long text, but hardly three.
BEGINNINGS = (3, 4, 5, 6)
LEVELS = 3


def distinct_words(text: str | None, part: int = 1 << 16) -> set[bytes]:
    """The different words of a text, read part by part."""
    data, out, at = (text or "").encode("utf-8", "replace").translate(WORD_TABLE), set(), 0
    while at < len(data):
        end = data.find(b" ", at + part)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def features(words: Iterable[bytes]) -> set[bytes]:
    """Words and their beginnings."""
    out = set(words)
    starts = Counter(w[:n] for w in out for n in BEGINNINGS if len(w) >= n)
    return out.union(start + b"*" * level for start, n in starts.items() for level in range(1, min(n, LEVELS) + 1))


class Classifier:
    """Weights by feature, and a bias."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self._words = {k: v for k, v in weights.items() if not k.endswith(b"*")}
        self._starts: list[tuple[int, dict[bytes, list[float]]]] = []  # by length: the weights of one, two ... words
        for n in BEGINNINGS:
            starts = {k.rstrip(b"*") for k in weights if k.endswith(b"*") and len(k.rstrip(b"*")) == n}
            self._starts.append((n, {x: [weights.get(x + b"*" * level, 0.0) for level in range(1, LEVELS + 1)] for x in sorted(starts)}))

    def score(self, text: str | None) -> float:
        words = distinct_words(text)
        parts = [self._words[w] for w in sorted(self._words.keys() & words)]
        for n, weights in self._starts:
            for start in sorted(weights.keys() & {w[:n] for w in words}):
                parts += weights[start][: sum(w.startswith(start) for w in words)]
        z = self.bias + sum(parts)
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

    @classmethod
    def fit(
        cls, digests: list[Digest], labels: np.ndarray, toxic_share: float = 0.1, support: int = 5, significance: float = 4.0,
        penalty: float = 5.0, decay: float = 5e-6, steps: int = 400, rate: float = 0.1,
    ) -> Classifier | None:
        """Full-batch Adam on log loss + decay * |w|^2 + penalty * mean squared score change over counterfactual pairs.

        Weights aren't negative: a text is toxic by what it has, and no amount of other words makes up for it.
        ``toxic_share``: of the rows that the sample stands for; classes are weighted to it.
        """
        labels = np.asarray(labels, float)
        if not len(labels) or labels.min() == labels.max():
            return None
        n = max(1, (labels == 0).sum()), max(1, (labels == 1).sum())
        identity = {w.encode() for g in IDENTITY_GROUPS for w in g}
        # Per feature: how many toxic texts have it. With too few it can't be significant, whatever clean texts have, so
        # that only the others are counted in those, with the marks of what is seen around them.
        toxic = Counter(f for (words, _, _), label in zip(digests, labels, strict=True) if label for f in features(words))
        share = lambda a, size: (a + 0.5) / (size + 1)
        toxic = {f: a for f, a in toxic.items() if f in identity or share(a, n[1]) * (n[1] + 1) >= significance**2 * (1 - share(a, n[1]))}
        toxic |= {f: toxic.get(f, 0) for f in identity}
        clean, around = Counter(), defaultdict(int)
        for (words, marks, _), label in zip(digests, labels, strict=True):
            if not label:
                clean.update(toxic.keys() & features(words))
            for word, mark in zip(words, marks, strict=True):
                for feature in (word, *[word[:k] + b"*" for k in BEGINNINGS if len(word) >= k]):
                    if feature in toxic:
                        around[feature] |= mark
        # Evidence: how surely a feature is commoner in toxic texts, if its surroundings vary enough.
        gain = {}
        for word, a in toxic.items():
            seen, b = around[word.rstrip(b"*") + b"*"] if word.endswith(b"*") else around[word], clean[word]
            varied = seen.bit_count() / min(63, a + b) if a + b else 0
            if seen.bit_count() >= support and (varied >= 0.5 or word in identity):
                p, q = share(a, n[1]), share(b, n[0])
                z = (p - q) / np.sqrt(p * (1 - p) / (n[1] + 1) + q * (1 - q) / (n[0] + 1))
                # A beginning stands for words that weren't seen; only one that is hardly ever clean may.
                if z >= significance and (not word.endswith(b"*") or p >= 0.8 * (p + q)) or word in identity:
                    gain[word] = z
        del toxic, clean, around
        vocabulary = {w: i for i, w in enumerate(sorted(gain))}
        pack = lambda rows: _Rows(([vocabulary[w] for w in r if w in vocabulary] for r in rows), len(vocabulary))
        x = pack(features(words) for words, _, _ in digests)
        pairs = counterfactuals(s for _, _, sentences in digests for s in sentences)
        one, two = pack(features(a) for a, _ in pairs), pack(features(b) for _, b in pairs)
        often = np.array([*pairs.values()]) / max(1, sum(pairs.values()))
        weight = np.where(labels == 1, toxic_share / labels.mean(), (1 - toxic_share) / (1 - labels.mean()))
        weight /= weight.sum()
        w, bias = np.zeros(len(vocabulary)), float(np.log(labels.mean() / (1 - labels.mean())))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, steps + 1):
            p = _sigmoid(x.dot(w) + bias)
            d = (p - labels) * weight
            g, gb = x.t_dot(d) + 2 * decay * w, d.sum()
            if len(pairs):
                p1, p2 = _sigmoid(one.dot(w) + bias), _sigmoid(two.dot(w) + bias)
                gap = 2 * penalty * (p1 - p2) * often
                d1, d2 = gap * p1 * (1 - p1), gap * p2 * (1 - p2)
                g, gb = g + one.t_dot(d1) - two.t_dot(d2), gb + d1.sum() - d2.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            scale = rate * (1 - t / (steps + 1)) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            w = np.maximum(w - scale * m / (np.sqrt(v) + 1e-6), 0)
            bias -= scale * mb / (np.sqrt(vb) + 1e-6)
        return cls({word: float(w[i]) for word, i in vocabulary.items() if abs(w[i]) > 1e-3}, float(bias))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: Iterable[list[int]], width: int):
        rows = list(rows)
        self.width, self.n = width, len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in sorted(r)], np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def t_dot(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, d[self.row], self.width)


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> Classifier | None:
    """A classifier fitted on at most ``sample_rows`` labelled rows that aren't held out, half of each label as far as
    there are such, chosen by a hash of doc_id. Of these rows everything counts: executors digest whole texts."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(~F.isnull("toxic") & F.col("toxic").isin(0, 1))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    learn = known.withColumnRenamed("id", "doc_id").where(~held_out())
    counts = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    quota = sample_rows // 2
    share = F.when(F.col("toxic") == 1, min(1.0, (1.3 * quota + 30) / counts[1])).otherwise(min(1.0, (1.3 * quota + 30) / counts[0]))
    u = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    chosen = learn.withColumn("u", u).where(F.col("u") < share).orderBy("u", "doc_id").limit(sample_rows + sample_rows // 2)  # a bounded table

    def digested(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [digest(t) for t in batch.column("text").to_pylist()]
        kinds = (pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.binary())))
        found = [pa.array([x[i] for x in made], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*batch.select(["u", "doc_id", "toxic", "key"]).columns, *found], names=["u", "doc_id", "toxic", "key", "words", "marks", "sentences"])

    # Of a document's rows one text, and of a text one row: what comes to the driver is bounded by ``chosen``, however often a
    # document is there.
    texts = documents.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id").select("u", "doc_id", "toxic", F.xxhash64("text").alias("key"), "text")
    kept = texts.groupBy("doc_id").agg(F.min("key").alias("key"), F.min("u").alias("first"))
    kept = kept.groupBy("key").agg(F.min_by("doc_id", F.struct("first", "doc_id")).alias("doc_id"))
    texts = texts.join(F.broadcast(kept), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.min("u").alias("u"), F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    with writing(documents.sparkSession):
        rows = map_arrow(texts, digested, f"u double, doc_id long, toxic int, key long, {_DIGEST}", 64).toArrow()
    rows = rows.sort_by([("u", "ascending"), ("doc_id", "ascending"), ("key", "ascending")])
    taken, places, seen, ids = Counter(), [], set(), set()
    for i, (doc, toxic, key) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "toxic", "key")), strict=True)):
        if taken[toxic] < quota and key not in seen and doc not in ids:
            taken[toxic] += 1
            places.append(i)
        seen.add(key)
        ids.add(doc)
    rows, known_words = rows.take(places), {}  # what isn't taken is freed
    own = known_words.setdefault  # one object for each word
    digests = []
    for words, marks, sentences in zip(rows.column("words"), rows.column("marks"), rows.column("sentences"), strict=True):
        digests.append(([own(w, w) for w in words.as_py()], marks.values.to_numpy().tolist(), [[own(w, w) for w in x] for x in sentences.as_py()]))
    truth = np.array(rows.column("toxic").to_pylist())
    del rows, known_words, own, texts, seen, ids
    model = Classifier.fit(digests, truth, toxic_share=counts[1] / (counts[0] + counts[1]))
    del digests
    trim()
    return model


def score(documents: DataFrame, model: Classifier | None) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t) if model is not None else 0.0 for t in batch.column("text").to_pylist()]
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), predicted], names=["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(documents: DataFrame, model: Classifier | None) -> DataFrame:
    """The documents that aren't predicted to be toxic, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [shared.value is None or shared.value.score(t.as_py()) < 0.5 for t in batch.column("text")]
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(documents, apply, documents.schema, 256)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, train(documents, labels))
