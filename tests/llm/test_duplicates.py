"""The Jaccard join, substring removal, components and the pipeline."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, debruijn, jaccard_join


def corpus(seed, n=250):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2000)] + ["É", "x.", "The"]
    passage = [r.choice(words) for _ in range(40)]
    bases = [[r.choice(words) for _ in range(r.randint(5, 150))] for _ in range(5)]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.55:
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.3:
                w = w[: r.randint(1, len(w))]
        elif kind < 0.8:
            w = [r.choice(words) for _ in range(r.randint(0, 60))] + passage + [r.choice(words) for _ in range(r.randint(0, 9))]
        elif kind < 0.9:
            w = [r.choice(words[:3]) for _ in range(r.randint(0, 20))]
        else:
            w = [r.choice(words) for _ in range(r.randint(1, 90))]
        out.append(r.choice([" ", "  ", "\n", "\t"]).join(w))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_join_is_exact(docs, clashing, seed):
    texts = [*corpus(seed), "", " \n", None]
    ids = [3 * i + 1 for i in range(len(texts))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.report(clashing(docs(texts, ids)).repartition(3)).collect()}
    assert got == brute.components(list(zip(ids, texts, strict=True)))


def test_regions_join_in_small_blocks(docs):
    """Blocks and second rounds: a large region with outliers, dealt over many blocks."""
    texts = corpus(9, 300)
    signed, classes, labels = jaccard_join.links(docs(texts), block=8)
    named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("label", "c").alias("label"))
    rows = signed.join(named, "c").select("doc_id", "label").collect()
    want = brute.components(list(enumerate(texts)))
    groups = {}
    for r in rows:
        groups.setdefault(r.label, set()).add(want[r.doc_id][1])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({want[r.doc_id][1] for r in rows})


def test_threshold_is_inclusive(docs):
    a = [f"a{i}" for i in range(13)]  # 9 shingles
    b = a + ["z"]  # one more: 9 of 10
    c = a + ["y", "x", "v"]  # 9 of 12
    got = {r.doc_id: r.component_id for r in jaccard_join.report(docs([" ".join(x) for x in (a, b, c)])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    # 4 of 5: exactly 0.8
    got = {r.doc_id: r.component_id for r in jaccard_join.report(docs(["p q r s t u v w", "p q r s t u v w x"])).collect()}
    assert got == {0: 0, 1: 0}


def test_prefixes_never_miss():
    for n in range(1, 60):
        for m in range(n, 60):
            for k in range(n + 1):
                if 100 * k >= 80 * (n + m - k):
                    # k in common, the others first in the order of both: still one in common is in each prefix
                    assert n - k < jaccard_join.prefix_length(n, 80) and m - k < jaccard_join.prefix_length(m, 80)


def test_join_cases(docs, clashing):
    assert jaccard_join.report(docs([])).count() == 0
    d = clashing(docs(["a b c d e f", "a b c d e f", "a b c d e f", "g", None, "z z"], ids=[5, 2, None, 7, 7, None]))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.report(d).collect())
    assert got == [(-1, 1, -1), (-1, 2, 2), (2, 2, 2), (5, 2, 2), (7, 0, 7), (7, 1, 7)]
    long = docs(["w " * 50_000 + "end", " ".join(map(str, range(30_000))), " ".join(map(str, range(30_001)))])
    assert {r.doc_id: r.component_id for r in jaccard_join.report(long).collect()} == {0: 0, 1: 1, 2: 1}


def test_keep_one(docs, clashing):
    d = clashing(docs(["a b c d e f", "A B c d e f", "other text", None, ""], ids=[4, 3, 9, 10, 11]))
    kept = jaccard_join.keep_one(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 9, 10, 11]


def test_components(spark):
    r = random.Random(2)
    order = r.sample(range(60), 60)  # ids are hashes: in no order along a chain
    chain = list(zip(order, order[1:]))
    edges = chain + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(40)] + [(7, 7)]
    got = {x.node: x.label for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in got for b in got)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes():
    import pyarrow as pa

    texts = ["a bb  a\tccc", None, "", "bb", "x" * 600_000 + " a", "é a"]
    data, offsets = common.text_bytes(pa.array(texts))
    starts, ends, rows = common.word_spans(data, offsets)
    hashes = common.word_hashes(data, starts, ends)
    words = [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)]
    assert rows.tolist() == [0, 4, 4, 4, 5, 7, 9]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (a == b) == (hashes[i] == hashes[j])
    assert len(np.unique(common.mix(np.arange(10_000, dtype=np.uint64)))) == 10_000


@pytest.mark.parametrize("seed", range(2))
def test_substrings_are_exact(docs, clashing, seed):
    texts = [*corpus(seed, 200), "", None, "one " * 200, "one " * 40]
    ids = random.Random(seed).sample(range(1000), len(texts))
    want = sorted(brute.substrings(list(zip(ids, texts, strict=True))))
    assert sorted(map(tuple, debruijn.report(clashing(docs(texts, ids)).repartition(3)).collect())) == want


def test_substring_cases(docs):
    assert debruijn.report(docs([])).count() == 0
    words = " ".join(f"u{i}" for i in range(20))
    rows = [(1, words), (1, words), (1, words + " tail"), (2, "x " + words), (None, words), (3, " ".join(words.split()[:13])), (4, " ".join(words.split()[:12]))]
    got = sorted(map(tuple, debruijn.report(docs([t for _, t in rows], [i for i, _ in rows])).collect()), key=repr)
    assert got == sorted(brute.substrings(rows), key=repr)
    kept = {r.doc_id: r.kept for r in debruijn.deduplicate(docs(["a " * 5 + words, words + " é"])).collect()}
    assert kept == {0: "a a a a a " + words, 1: "é"}


def test_regions_part_into_cells(spark):
    """Large regions go through several rounds of cells; every link is found or lies within a component."""
    r = np.random.default_rng(3)
    bases = [r.integers(0, 5000, 40) for _ in range(25)]
    sets = [np.unique(np.concatenate([b[: 40 - n], r.integers(0, 5000, n)])) for b in bases for n in r.integers(0, 7, 20)]
    ids = [i.to_bytes(16, "big") for i in range(len(sets))]
    table = spark.createDataFrame([(i, s.tolist()) for i, s in zip(ids, sets, strict=True)], "c binary, items array<long>")
    mixed = spark.createDataFrame([(1, i, i, 3, 1 << 62) for i in ids], "r long, c binary, label binary, role int, parent long")
    edges = {(bytes(e.a), bytes(e.b)) for e in jaccard_join._joined_regions(common.materialize(mixed, "t"), common.materialize(table, "t"), 80, 8, pivots=5, most=2).collect()}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    where = dict(zip(ids, sets, strict=True))
    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: i for i in ids}

    def find2(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(where[a], where[b]):
                want[max(find2(a), find2(b))] = min(find2(a), find2(b))
    assert [find(i) for i in ids] == [find2(i) for i in ids]


def test_paths_of_the_graph(spark):
    """Nonbranching paths of a small graph: edges of three words, whose nodes are two words."""
    rows, texts = [], {1: "a b c d e f", 2: "x b c d e y", 3: "p c d e f g", 4: "f g h a b c"}
    words = {k: t.split() for k, t in texts.items()}
    grams = {}
    for k, w in words.items():
        for i in range(len(w) - 2):
            grams.setdefault(tuple(w[i : i + 3]), []).append((k, i))
    number = lambda x: hash(x) >> 2
    for gram, places in grams.items():
        doc, start = min(places)
        rows.append((number(gram), 0, 2, doc, 0, start, 1, number(gram[:2]), number(gram[1:])))
    graph = spark.createDataFrame(rows, "k long, c int, level int, source long, source_key long, source_start int, count int, head long, tail long")
    got = {}
    for x in debruijn._compacted(graph).collect():
        got.setdefault(x.path, set()).add(x.k)
    # Brute force: neighbours through nodes with one way in and one way out.
    into, out = {}, {}
    for g in grams:
        out.setdefault(g[:2], []).append(g)
        into.setdefault(g[1:], []).append(g)
    group = {g: {g} for g in grams}
    for node in out:
        if len(out[node]) == 1 and len(into.get(node, [])) == 1:
            joined = group[into[node][0]] | group[out[node][0]]
            for g in joined:
                group[g] = joined
    assert {frozenset(x) for x in got.values()} == {frozenset(number(g) for g in x) for x in group.values()}


def test_hot_keys_join(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(600)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = common.join_hot(common.materialize(left, "t"), common.materialize(right, "t"), ["k"], lambda d: d.select("k", "v"), share=20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.collect()))
