"""Ranked search and divergence against plain versions, and their defined cases."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from weftline.llm import divergence, lexical
from weftline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string"
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def ranked(docs, items, k=10):
    """The contract, one document after the other."""
    words = [(d, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    terms = defaultdict(set)
    for item, text in items:
        terms[item] |= set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text)))
    out = []
    for item, wanted in terms.items():
        scored = []
        for d, w in words:
            tf, m, score = Counter(w), 10 + 90 * len(w) * n // total, 0
            for t in wanted & tf.keys():
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def searched(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def texts(r, n, words):
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(r.choices(words, weights, k=r.randint(0, 30))) for _ in range(n)]


def test_search(spark, docs, clashing):
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["É", "ab-cd", "X.y", "日本"]
    rows = texts(r, 300, words)
    rows += [rows[3]] * 40 + [None, "", " -- ", "w1 " * 5000]  # copies tie; their ids decide
    ids = [*range(len(rows))]
    r.shuffle(ids)
    ids[5] = ids[6] = None
    items = [*enumerate(texts(r, 30, words)), (7, "w1 w39"), (None, "w2"), (None, "w30"), (90, ""), (91, None), (92, "nowhere"), (93, rows[3])]
    want = ranked(list(zip(ids, rows, strict=True)), items)
    table, asked = docs(rows, ids=ids), spark.createDataFrame(items, ITEMS)
    assert searched(lexical.search(clashing(table), clashing(asked))) == want
    # Many small shards of items, and few rows in a block.
    assert searched(lexical.search(table, asked, shard_bytes=400)) == want
    assert searched(lexical.search(table, asked, k=1)) == ranked(list(zip(ids, rows, strict=True)), items, 1)


def test_search_of_nothing(spark, docs):
    asked = spark.createDataFrame([(1, "a b")], ITEMS)
    assert lexical.search(docs([]), asked).count() == lexical.search(docs([None, "-"]), asked).count() == 0
    assert lexical.search(docs(["a"]), spark.createDataFrame([], ITEMS)).count() == 0
    assert searched(lexical.search(docs(["a"]), spark.createDataFrame([("x", "a")], "item_id string, text string"))) == ranked([(0, "a")], [("x", "a")])


def test_bounds_hold_and_prune(spark, docs):
    """Bytes bound impacts, blocks and parts don't matter, and few documents are scored exactly."""
    rng = np.random.default_rng(1)
    counts, sizes = rng.integers(1, 1000, 5000), rng.integers(10, 100000, 5000)
    exact = lexical.impacts(counts, sizes)
    level = -(-exact // lexical.UNIT)
    assert level.max() <= 255 and ((level - 1) * lexical.UNIT < exact).all() and (exact <= level * lexical.UNIT).all()
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, items = texts(r, 2000, words), texts(r, 20, words)
    index = lexical.build(docs(rows), sorted({w.encode() for t in items for w in t.split()}), 256)
    vocabulary = sorted({w for t in items for w in t.split()})
    pairs = sorted({(q, vocabulary.index(w)) for q, t in enumerate(items) for w in t.split()})
    owner, terms = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    weights = np.array([index.weight(t) for t in range(len(vocabulary))])
    found = lexical.Search(owner, terms, weights[terms], len(items), 10)
    for b in index.blocks.toArrow().to_batches():
        for i in range(b.num_rows):
            parts = [np.frombuffer(b.column(c)[i].as_py(), kind).astype(np.int64) for c, kind in (("places", np.uint16), ("counts", np.uint32), ("impacts", np.uint8))]
            found.add(b.column("docs")[i].values, *[b.column(c)[i].values.to_numpy().astype(np.int64) for c in ("sizes", "terms", "starts")], *parts)
    got = found.rows().to_pylist()
    want = ranked(list(enumerate(rows)), list(enumerate(items)))
    assert sorted((x["query"], x["doc_id"], x["score"]) for x in got) == sorted((q, d, s) for q, _, d, s in want)
    assert found.scored < 0.2 * len(items) * len(rows)


def test_length_numbers():
    assert lexical.length_numbers(np.array([10**7]), 10**11, 10**13).tolist() == [10 + 90 * 10**7 * 10**11 // 10**13]


def audited(rows, least=30, most=50):
    """The contract, with every term of every group."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))) for t, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in rows}:
        own = [(s, w) for x, s, w in rows if x == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        counts = {s: Counter(t for x, w in own if x == s for t in w) for s in {s for s, _ in own}}
        total = sum(counts.values(), Counter())

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in p:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:most]
            out += [(lang, s, part, o.decode(), -v, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (v, o) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def sourced(spark):
    r = random.Random(8)
    common, rare = ["the", "of", "Und", "É", "x1y"], [f"t{a}{b}" for a in "abcdefgh" for b in "xyz"]
    rows = []
    for _ in range(700):
        source = f"s{min(r.randrange(40), 25)}"  # one of them has a third of all rows
        own = rare[len(rows) % 3 :: 5] if r.random() < 0.7 else rare
        rows.append((" ".join(r.choices(common, k=r.randint(0, 20)) + r.choices(own, k=r.randint(0, 6))), r.choice(["en", "de"]), source))
    return rows + [("the " * 3000, "en", "s1"), (None, "en", "empty"), ("", "fr", "one"), ("a b", None, None), (None, None, "s2"), ("the", "en", "É")] + [rows[0]] * 50


@pytest.mark.parametrize("sizes", [{}, {"heavy_groups": 0}, {"heavy_groups": 99}, {"heavy_groups": 12, "tile_groups": 4, "chunk_terms": 5}])
def test_audit(spark, clashing, sourced, sizes):
    table = clashing(spark.createDataFrame(sourced, "text string, lang string, source string").withColumn("doc_id", lexical.F.lit(1)))
    assert rows_of(divergence.audit(table, least_docs=10, most_terms=4, **sizes)) == audited(sourced, 10, 4)


def test_audit_in_slices(spark, sourced):
    """Counts are the same however rows are sliced and however often they are given on."""
    table = spark.createDataFrame(sourced, "text string, lang string, source string")
    got = [sorted(map(tuple, divergence.term_counts(table, 10, rows, most)[2].collect())) for rows, most in ((1024, 10**6), (7, 40))]
    assert got[0] == got[1] and got[0]


def test_audit_cases(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0
    few = [("a", "en", "x"), (None, "en", "y"), (None, "de", "x")]
    assert rows_of(divergence.audit(spark.createDataFrame(few, empty.schema))) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)] == audited(few)
    # Shares stay exact where 10^9 times a count is beyond 64 bits.
    big = spark.createDataFrame([(10**12, 3 * 10**12, 7)], "c long, n long, v long")
    assert big.select(divergence._share(*[lexical.F.col(x) for x in "cnv"]).alias("p")).first()["p"] == 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 35)


@pytest.mark.parametrize("name", ["op12_lexical", "op13_divergence"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[want.columns]
    key = lambda frame: sorted(map(tuple, frame.astype(object).to_numpy().tolist()))
    assert key(got) == key(want) and len(want)
