"""Quality: statistics and densities against plain versions, held-out accuracy, defined cases."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def prose(r, n):
    words = ["".join(r.choice("the ing tion an er ou sh ea".split()) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(words))


def junk(r, n):
    kind, text = r.randrange(4), prose(r, n)
    if kind == 0:
        return " ".join(w + r.choice(["###", "&&&", "$$$"]) for w in text.split())
    return text.upper() if kind == 1 else " | ".join(text.split()) if kind == 2 else " ".join([text.split()[0]] * n)


def plain(text):
    """The statistics of a text, one by one."""
    raw = (text or "").encode()
    kind = lambda b: "beyond" if b >= 128 else "space" if chr(b) in " \t\n\v\f\r" else "digit" if 48 <= b < 58 else "upper" if 65 <= b < 91 else "lower" if 97 <= b < 123 else "plain" if chr(b) in ".,;:?'\"()-" else "symbol"
    share = lambda a, n: math.asin(math.sqrt(a / n)) if n else 0.0
    kinds, words = [kind(b) for b in raw], re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, total = len(words), len(raw)
    seen = [words.count(w) for w in set(words)]
    out = [math.log(n + 1), math.log((total - kinds.count("space") + 5) / (n + 1))]
    out += [share(kinds.count(k), total) for k in ("upper", "digit", "space", "plain", "symbol", "beyond")]
    out += [share(sum(kind(w[-1]) == "symbol" for w in words), n)]
    out += [share(sum(not any(kind(b) in ("upper", "lower", "beyond") for b in w) for w in words), n)]
    out += [share(sum(2 * sum(kind(b) == "upper" for b in w) > len(w) for w in words), n)]
    out += [math.log((len(seen) + 1) / (n + 1)), math.log((max(seen, default=0) + 1) / (n + 1))]
    out += [share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n)]
    return [round(x * 1024) for x in out]


def test_statistics():
    r = random.Random(5)
    texts = [None, "", " \n", "a", "É é", "x x x", "A!! B## 12 c", prose(r, 300), junk(r, 50), "word " * 3000, "\x00 b"]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert np.abs(got - np.array([plain(t) for t in texts])).max() <= 1  # a rounding apart
    assert len(quality.statistics(pa.array([], pa.string()))) == 0


@pytest.fixture(scope="module")
def table():
    r = random.Random(11)
    truth = [int(r.random() < 0.8) for _ in range(600)]
    return [prose(r, r.randint(5, 200)) if good else junk(r, r.randint(5, 200)) for good in truth], truth


def learned(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def test_held_out_accuracy(spark, docs, clashing, table):
    texts, truth = table
    # Held-out labels are wrong on purpose: nothing may be learned from them.
    labels = spark.createDataFrame([(i, y if learned(i) else 1 - y, 0) for i, y in enumerate(truth)], LABELS)
    got = {r.doc_id: r for r in quality.report(clashing(docs(texts)), clashing(labels)).collect()}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if not learned(i)] and len(got) == 600
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_score_is_the_difference_of_log_densities(table):
    texts, truth = table
    x, y = quality.statistics(pa.array(texts)).astype(np.int64), np.array(truth)
    moments = np.array([np.concatenate([[(y == k).sum()], x[y == k].sum(0), (x[y == k].T @ x[y == k]).ravel()]) for k in (0, 1)])
    model = quality.Discriminant.fit(moments, floor=0.2)
    d, z, density = x.shape[1], x / 1024, []
    pooled = sum((y == k).mean() * np.cov(z[y == k].T, bias=True) for k in (0, 1))
    for k in (0, 1):
        m = d * (d + 1) / 2
        own = np.cov(z[y == k].T, bias=True)
        c = 0.8 * (own * (y == k).sum() + pooled * m) / ((y == k).sum() + m) + 0.2 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
        gap = z - z[y == k].mean(0)
        density.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (gap @ np.linalg.inv(c) * gap).sum(1))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30))), atol=1e-6)


def test_cases(spark, docs, table):
    texts, truth = table
    none, one = spark.createDataFrame([], LABELS), spark.createDataFrame([(i, 1, 0) for i in range(600)], LABELS)
    assert {r.score for r in quality.report(docs(texts[:20]), none).collect()} == {0.0}
    assert {(r.score, r.predicted) for r in quality.report(docs(texts[:20]), one).collect()} == {(1.0, 1)}
    assert quality.report(docs([]), one).count() == 0
    # A text repeated very often, labels of both kinds for one document, null and other labels change nothing.
    labels = [(i, y, 0) for i, y in enumerate(truth)]
    often = docs(texts + [texts[1]] * 2000, ids=[*range(600)] + [1] * 2000)
    odd = spark.createDataFrame([*labels, *labels, (None, 1, 0), (5, None, 1), (7, 4, 0)], LABELS)
    want = {r.doc_id: r.score for r in quality.report(docs(texts), spark.createDataFrame(labels, LABELS)).collect()}
    got = quality.report(often, odd).collect()
    assert len(got) == 2600 and all(r.score == want[r.doc_id] for r in got)
    # Null ids, null, empty and very long texts.
    model = quality.train(quality.described(docs(texts)), spark.createDataFrame(labels, LABELS))
    rows = quality.score(quality.described(docs([None, "", "é", texts[0] * 500], ids=[None, 1, 1, None])), model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and all(r.held_out for r in rows if r.doc_id is None)
    both = spark.createDataFrame([*labels, *[(i, 0, 0) for i in range(600)]], LABELS)
    assert quality.train(quality.described(docs(texts)), both) == 0.0
