"""Session stores, deletion, JSON text, table functions and mixes."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import tables
from weftline.functions.json_text import ascii_bytes, json_text
from weftline.operators import retention, sessions, urlguard
from weftline.sources import readers

SESSION = "session_id string, url string, grp string, created_at string, content string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_is_pruned(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(f"s{i}", "u", [None, "", "a", "b/c", "public", "1"][i % 6], "2026", f"text {i} " * 50) for i in range(60)]
    sessions.write(spark.createDataFrame(rows, SESSION), path, 100, 4)
    back = sessions.read(spark, path, buckets=4)
    assert sorted((r.session_id, r.grp or "", r.grp is None, r.content) for r in back.collect()) == sorted((i, g or "", g is None, c) for i, _, g, _, c in rows)
    mine = sessions.read(spark, path, ["a", "nobody"], buckets=4)
    assert {r.grp for r in mine.collect()} == {None, "a"} and "PartitionFilters: [" in plan(mine) and "part#" in plan(mine).split("PartitionFilters: [")[1][:80]
    some = sessions.read(spark, path, ["a"], ["s2", "s3", "s0"], 4)
    assert sorted(r.session_id for r in some.collect()) == ["s0", "s2"] and "bucket#" in plan(some).split("PartitionFilters: [")[1].split("]")[0]
    wanted = spark.createDataFrame([("s7", 1), ("s7", 99), ("gone", 0)], "session_id string, chunk_index int")
    got = {(r.session_id, r.chunk_index): (r.chunk, r.error_code) for r in sessions.read_chunks(spark, path, wanted, 4).collect()}
    assert got == {("s7", 1): (rows[7][4][100:200], None), ("s7", 99): (None, "INVALID_CHUNK_INDEX")}
    assert sessions.read(spark, path, ids=[], buckets=4).count() == 0


def test_content_that_is_no_text(spark, tmp_path):
    d = spark.createDataFrame([("s", "u", None, "t", {"a": [1, None], "b": None})], "session_id string, url string, grp string, created_at string, content struct<a:array<int>,b:string>")
    sessions.write(d, str(tmp_path / "s"))
    r = sessions.read(spark, str(tmp_path / "s")).first()
    assert r.content == '{"a": [1, null], "b": null}' and (r.total_chars, r.size, r.total_chunks) == (27, 27, 1)


def test_json_text(spark):
    r = random.Random(3)
    numbers = [0.0, -0.0, 1.0, 0.1, 1e-4, 9.99e-5, 1e-5, 123456.789, 1e7, 12345678.9, 1e15, 9.9e15, 1e16, 1.5e300, -2.5e-300, 5e-324, math.inf, -math.inf, 1 / 3, 100000000.0] + [r.uniform(-1, 1) * 10 ** r.randint(-20, 20) for _ in range(300)]
    texts = ["", 'q"\\/\b\f\n\r\t', "\x00\x0b\x1f\x7f", "é€😀", "a\\u000Bb\x0b", None, "\\\x1a\"", "]", "[\"x\"]"]
    rows = [(i, texts[i % len(texts)], numbers[i % len(numbers)], i % 2 == 0, [texts[(i + j) % len(texts)] for j in range(i % 3)], {"k é": i, "n": None} if i % 4 else None, (i, None)) for i in range(len(numbers))]
    d = spark.createDataFrame(rows, "i long, t string, f double, b boolean, a array<string>, m map<string,int>, s struct<x:long,y:string>")
    names = ["i", "t", "f", "b", "a", "m", "s"]
    out = d.select("i", json_text(F.struct(*names), d.schema).alias("j")).withColumn("n", ascii_bytes(F.col("j"))).collect()
    for x, row in zip(sorted(out), rows, strict=True):
        value = dict(zip(names, row, strict=True)) | {"s": {"x": row[6][0], "y": None}}
        # The order of a map's keys is the map's; numbers read back are what counts where their shortest text differs.
        got, want = json.loads(x.j), json.dumps(value, ensure_ascii=False)
        assert got == value
        assert x.j == want or json.dumps(got, ensure_ascii=False) == want and abs(len(x.j) - len(want)) <= 2, (x.j, want)
        assert x.n == len(x.j.encode()) + sum(6 - len(c.encode()) if ord(c) < 65536 else 12 - 4 for c in x.j if ord(c) > 127)


def test_inline(spark):
    d = spark.createDataFrame([("x", None), ("é" * 30, "y")], "a string, b string")
    one, two = sessions.inline(d, 40).collect()
    assert (one.json, one.bytes, one.error_code, one.error) == ('{"a": "x", "b": null}', 21, None, None)
    assert (two.json, two.bytes, two.error_code) == (None, 199, "CONTENT_TOO_LARGE") and two.error.startswith("Inline response is 199 bytes, exceeding max_bytes limit of 40.")
    clash = sessions.inline(spark.createDataFrame([("x", 1)], "json string, bytes int"), 40).columns
    assert clash[:2] == ["json", "bytes"] and len(set(clash)) == 6


def test_lookup(spark):
    d = sessions.stored(spark.createDataFrame([("s1", "u", "a", "t", "x"), ("s2", "u", None, "t", "y"), ("same", "u", "b", "t", "z")], SESSION))
    aliases = spark.createDataFrame([("one", "s1"), ("same", "s2"), ("dead", "s9")], "alias string, session_id string")
    wanted = spark.createDataFrame([(x,) for x in ["s1", "one", "same", "dead", "no", None]], "asked string")
    got = {r.asked: (r.session_id, r.error_code) for r in sessions.looked_up(wanted, d, aliases, ["a"]).collect()}
    assert got == {"s1": ("s1", None), "one": ("s1", None), "same": (None, "PERMISSION_DENIED"), "dead": (None, "SESSION_NOT_FOUND"), "no": (None, "SESSION_NOT_FOUND"), None: (None, "SESSION_NOT_FOUND")}
    assert {r.error_code for r in sessions.looked_up(wanted.where("asked = 'same'"), d, aliases).collect()} == {None}


def files(path):
    return {(d, f): os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_deletion_deletes(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([(f"g{i}", f"p{i % 3}", f"x{i % 2}", i) for i in range(30)], "guid string, p string, q string, v int")
    d.write.partitionBy("p", "q").parquet(path)
    before = files(path)
    doomed = spark.read.parquet(path).where("(p = 'p0' and v < 10) or (p = 'p1' and q = 'x1')")
    gone = {r.guid for r in doomed.collect()}
    assert gone
    retention.delete(spark, path, doomed, ["guid"], ["p", "q"])
    left = spark.read.parquet(path)
    assert {r.guid for r in left.collect()} == {f"g{i}" for i in range(30)} - gone and left.count() == 30 - len(gone)
    after = files(path)
    assert {k: v for k, v in before.items() if "/p=p2" in k[0] or "p=p1/q=x0" in k[0]}.items() <= after.items()
    assert not any("p=p1/q=x1" in k[0] for k in after) and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    # Repeated, and with nothing to delete, it changes nothing.
    retention.delete(spark, path, left.where("v < 0"), ["guid"], ["p", "q"])
    assert files(path) == after


def test_table_functions(spark):
    tables.register(spark)
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()))
    assert rows("SELECT * FROM split_chunks('abcde', 2)") == [(0, "ab"), (1, "cd"), (2, "e")] and rows("SELECT * FROM split_chunks('', 2)") == [(0, "")] and rows("SELECT * FROM split_chunks(cast(null as string), 2)") == []
    assert rows("SELECT * FROM split_chunks('a b  c', 2, 'words')") == [(0, ["a", "b"]), (1, ["c"])]
    for bad in ("split_chunks(1, 2)", "split_chunks('a', 0)", "split_chunks('a', 1, 'lines')", "robots_rules(TABLE(SELECT 1 AS host))"):
        with pytest.raises(Exception):  # noqa: B017
            rows(f"SELECT * FROM {bad}")
    lines = spark.createDataFrame([("a", 1, "Disallow: /x"), ("a", 0, "User-agent: *"), ("b", 0, "User-agent: q"), ("b", 1, None), ("b", 2, "Allow: /"), ("c", 0, "nothing")], "host string, line_no int, line string")
    got = sorted(map(tuple, spark.sql("SELECT host, agent, path, allow FROM robots_rules(TABLE({t}))", t=lines).collect()))
    assert got == [("a", "*", "/x", False), ("b", "q", "/", True)]


@pytest.mark.parametrize(
    ("text", "told"),
    [
        ('{"groups": {}}', "non-empty 'groups'"), ("{}", "non-empty 'groups'"), ("x", "non-empty 'groups'"), ('{"groups": {"a": {"count": 0}}}', "at least one entry"), ('{"groups": {"a": {"count": -1}}}', "invalid count"),
        ('{"groups": {"a": {"count": "2"}}}', "invalid count"), ('{"groups": {"a": {"count": 1.5}}}', "invalid count"), ('{"groups": {"a": {}}}', "invalid count"), ('{"groups": {"a": {"count": 1, "token": 5}}}', "token must be"),
        ('{"groups": {"a": 3}}', "invalid count"),
    ],
)
def test_bad_mixes(spark, text, told):
    with pytest.raises(Exception, match=told):
        readers.mix(spark.createDataFrame([(text,)], "value string")).collect()


def test_mix(spark):
    text = '{"groups": {"a": {"count": 2, "token": null}, "b": {"count": 0, "token": "x"}, "c": {"count": 1, "token": "t\\u00e9"}}}'
    assert sorted(map(tuple, readers.mix(spark.createDataFrame([(text,)], "value string")).collect())) == [("a", 2, None), ("c", 1, "té")]


def test_guard_keeps_other_columns(spark):
    urls = spark.createDataFrame([("http://10.0.0.1/", "h", True, "b"), ("http://ok/", "h", False, "b")], "url string, hit string, guard_hit boolean, blocked string")
    got = urlguard.check(urls, spark.createDataFrame([("ok", "1.1.1.1")], "host string, address string")).collect()
    assert sorted((r.verdict, r.hit, r.blocked) for r in got) == [("SSRF_BLOCKED", "h", "b"), ("ok", "h", "b")]
