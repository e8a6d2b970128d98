"""Distributed percentiles against numpy."""

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import metrics, ranks

SHARES = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    rows = [("a", None, float(x)) for x in rng.normal(0, 50, 3000).round(1)] + [("a", "x", 7.0)] * 2000 + [("b", "x", float(x)) for x in rng.integers(0, 4, 100)] + [("c", "y", 1.5), (None, "y", 2.0), (None, "y", 9.0), ("d", "z", None)]
    d = spark.createDataFrame(rows, "t string, u string, v double")
    counts = d.groupBy("t", "u", "v").agg(F.count("*").alias("n"))
    found = metrics.percentiles(counts, ["t", "u"], "v", "n", SHARES)
    got = {(r.t, r.u): r.p for r in found.collect()}
    want = {}
    for t, u, v in rows:
        if v is not None:
            want.setdefault((t, u), []).append(v)
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert np.allclose(got[k], np.quantile(values, SHARES), rtol=1e-12, atol=1e-12)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in text and "collect" not in text
    assert metrics.percentiles(counts.limit(0), ["t", "u"], "v", "n", SHARES).count() == 0


def test_one_key_over_many_ranges(spark):
    """All rows have one key: every task has a part of it."""
    d = spark.range(50000).select(F.lit("k").alias("key"), (F.col("id") * 7919 % 50000).alias("v"), F.lit(1).alias("n"), F.lit("mine").alias("part"))
    assert metrics.percentiles(d, ["key"], "v", "n", [0.5, 0.999]).first().p == np.quantile(np.arange(50000), [0.5, 0.999]).tolist()


def test_numbered(spark):
    d = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("v"), F.lit("mine").alias("part"))
    got = ranks.numbered(d.unionByName(d.limit(100)), ["v"], "place")
    rows = got.orderBy("place").collect()
    assert [r.place for r in rows] == [*range(1, 20101)] and [r.v for r in rows] == sorted(r.v for r in rows) and got.columns == ["v", "part", "place"]
    assert ranks.numbered(d.limit(0), ["v"], "place").count() == 0
