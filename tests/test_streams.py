"""Stateful streams and the source of stored responses, against plain versions."""

import base64
import datetime
import json
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline.operators.crawl import crawl
from weftline.sources import responses
from weftline.streaming import limits, state

CALLS = "event_id long, user_id long, s double"


def calls(spark, rows):
    return spark.createDataFrame(rows, CALLS).select("event_id", "user_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))


def in_parts(spark, parts, path, make):
    """The rows of a stream whose input arrives in parts, with a restart of the query before each."""
    found = None
    for n, part in enumerate(parts):
        part.write.parquet(f"{path}/in/part={n}")
        source = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        found = state.run_available(make(source), path)
    return found


def test_limiter_keeps_its_state(spark, tmp_path):
    r = random.Random(3)
    rows, t = [], 0.0
    for i in range(120):
        t += r.choice([0.0, 0.5, 5.0, 30.0])
        rows.append((i, r.choice([1, 2]), t))
    d = calls(spark, rows)
    want = {r.event_id: r.admitted for r in limits.limited(d, 3, 20.0).collect()}
    parts = [d.where(F.col("event_id").between(a, a + 39)) for a in (0, 40, 80)]
    got = in_parts(spark, parts, tmp_path, lambda s: state.limited_stream(s, 3, 20.0)).collect()
    assert {r.event_id: r.admitted for r in got} == want and len(got) == 120 and len(set(want.values())) == 2


def plain_releases(rows, delay):
    out, last = {}, {}
    for event, domain, t in sorted(rows, key=lambda x: (x[2], x[0])):
        last[domain] = t if domain not in last else max(t, last[domain] + delay)
        out[event] = (last[domain], last[domain] - t)
    return out


def test_releases(spark, tmp_path):
    r = random.Random(4)
    rows, t = [], 100.0
    for i in range(90):
        t += r.choice([0.0, 0.25, 1.0, 4.0])
        rows.append((i, r.choice([1, 2, 3]), t))
    want = plain_releases(rows, 2.0)
    d = calls(spark, rows).withColumnRenamed("user_id", "domain")
    seconds = lambda x: x.replace(tzinfo=datetime.UTC).timestamp()
    batch = {x.event_id: (seconds(x.release), x.wait) for x in state.released(d, 2.0).collect()}
    assert batch == want
    # A last call moves the watermark on, so that everything before it comes out; it waits for its own time.
    parts = [d.where("event_id < 45"), d.where("event_id >= 45"), calls(spark, [(999, 1, 100000.0)]).withColumnRenamed("user_id", "domain")]
    stream = {x.event_id: (seconds(x.release), x.wait) for x in in_parts(spark, parts, tmp_path, lambda s: state.released_stream(s, 2.0, "0 seconds")).collect()}
    assert {k: v for k, v in stream.items() if k != 999} == want


class Kept:
    """A stand-in for states and their handle; counts what is asked of them."""

    def __init__(self):
        self.asked, self.timers, self.value, self.rows = 0, [], None, []

    def getValueState(self, *_):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815

    def __getattr__(self, name):
        def call(*given):
            self.asked += 1
            if name == "registerTimer":
                self.timers += given
            elif name == "update":
                self.value = given[0]
            elif name == "get":
                return self.rows or self.value
            elif name == "exists":
                return bool(self.rows)
            elif name in ("appendList", "put", "clear"):
                self.rows = (self.rows if name == "appendList" else []) + (given[0] if given else [])

        return call

    getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: self.now  # noqa: N815, E731


def test_a_domain_has_one_timer():
    """What is asked of the state doesn't grow with the requests that wait."""
    spacer, kept, waiting = state.Spacer(2_000_000), Kept(), Kept()
    spacer.init(kept)
    spacer.waiting = waiting
    assert list(spacer.handleInputRows((1,), iter([Row(event_id=i, at=1000 * i) for i in range(500)][::-1]), kept)) == []
    assert kept.asked + waiting.asked < 8 and kept.timers == [0]
    kept.now = 20_000
    out = list(spacer.handleExpiredTimer((1,), kept, kept))
    assert [(r.event_id, r.due) for r in out] == [(i, 2_000_000 * i) for i in range(11)] and kept.timers == [0, 22_000]
    list(spacer.handleInputRows((1,), iter([Row(event_id=500, at=9)]), kept))
    assert kept.timers == [0, 22_000] and len(waiting.rows) == 490
    kept.now = 10**7
    assert [r.due for r in spacer.handleExpiredTimer((1,), kept, kept)][-1] == 1_000_000_000 and waiting.rows == [] and kept.asked + waiting.asked < 20


def test_crawl_by_stream(spark):
    r = random.Random(6)
    urls = [f"http://h{i % 2}/{i}" for i in range(40)]
    slash = lambda u: u + r.choice(["", "/", "//"])
    pages = [(slash(u), [slash(r.choice([*urls, "http://h0/gone", "http://h1/gone", "mailto:x"])) for _ in range(r.randint(0, 12))]) for u in urls]
    d = spark.createDataFrame(pages, "url string, links array<string>")
    seeds = spark.createDataFrame([(i, u) for i, u in enumerate([*urls[:25], "http://h0/gone"])], "crawl_id long, start_url string")
    for depth, per_level in ((3, 2), (2, 5), (1, 5)):
        got = state.crawl_by_stream(seeds, d, depth, per_level).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, crawl(seeds, d, depth, per_level).collect())) and got


def test_a_crawl_asks_its_state_twice():
    """However many pages a level has, its state is read once and written once."""
    frontier, kept = state.Frontier(3), Kept()
    frontier.init(kept)
    page = lambda pos, key, depth, *out: Row(pos=pos, key=key, depth=depth, start_host="h", host="h", out=[Row(link=x + "/", key=x) for x in out])
    assert [(r.pos, r.key) for r in frontier.handleInputRows((1,), iter([page(0, "a", 1, "a", "b", "c", "d", "e")]), None)] == [(0, "b"), (1, "c"), (2, "d")]
    assert kept.asked == 2
    assert [(r.pos, r.key) for r in frontier.handleInputRows((1,), iter([page(2, "d", 2, "a", "g"), page(0, "b", 2, "d", "f")]), None)] == [(1, "f"), (2, "g")]
    assert kept.asked == 4 and kept.value == (["a", "b", "c", "d"], ["d", "f", "g"])


ATTEMPTS = "host string, url string, attempt int, at double, status int, reason string, headers map<string,string>, body binary, failure string"


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [
        ("a:80", "http://a/1", 0, 0.0, 429, None, {"retry-after": "7"}, b"", None), ("a:80", "http://a/1", 1, 1.0, 0, None, None, None, "reset"),
        ("a:80", "http://a/1", 2, 2.0, 200, "OK", {"CONTENT-type": "text/html; charset=iso-8859-1"}, "Zürich".encode("latin-1"), None), ("a:80", "http://a/1", 3, 3.0, 404, None, {}, b"late", None),
        ("b", "http://b/1", 0, 0.0, 200, None, {"Content-Type": "text/html"}, b"\xff", None), ("b", "http://b/2", 0, 0.0, 503, "Busy", {}, b"x", None),
        *[("b", "http://b/3", n, float(n), 0, None, None, None, f"timeout {n}") for n in range(4)], ("c", "http://c/1", 0, 0.0, 403, "No", {"Location": "/x"}, "é\n".encode(), None),
    ]
    responses.write_responses(spark.createDataFrame(rows, ATTEMPTS).withColumn("extra", F.lit(1)), path, file_rows=3)
    d = responses.responses(spark, path)
    assert d.count() == len(rows) and d.rdd.getNumPartitions() > 3
    some = responses.responses(spark, path, ["b", "nowhere"])
    assert {r.host for r in some.collect()} == {"b"} and some.rdd.getNumPartitions() < d.rdd.getNumPartitions()
    got = {r.url: r for r in responses.fetch_results(d).collect()}
    a = got["http://a/1"]
    assert (a.status_code, a.content, a.encoding, a.error, a.retry_count, a.rate_limited, a.waited) == (200, "Zürich", "iso-8859-1", None, 2, True, 9.0)
    b = got["http://b/1"]
    assert (b.status_code, b.content, b.encoding) == (0, "", "utf-8") and b.error.startswith("Unexpected error: 'utf-8' codec can't decode byte 0xff")
    assert (got["http://b/2"].error, got["http://b/2"].retry_count) == ("HTTP 503 Busy", 0)  # what there is of a retry
    assert (got["http://b/3"].error, got["http://b/3"].waited) == ("HTTP error after 4 attempts: timeout 3", 7.0)
    assert (got["http://c/1"].error, got["http://c/1"].content) == ("HTTP 403 No", "é\n")
    assert d.where("url = 'http://c/1'").first().location == "/x"
    assert {r.url: r.error for r in responses.fetch_results(d, 0).collect()}["http://a/1"] == "HTTP 429 Unknown"


def test_parts_of_a_file(tmp_path):
    """However a file is cut, every line is read once; blank lines are none."""
    lines = [json.dumps({"url": f"u{i}", "body": base64.b64encode(b"x" * i).decode()}) for i in range(40)]
    file = tmp_path / "f.json"
    file.write_text("\n".join([*lines[:20], "", *lines[20:]]) + "\n")
    size = file.stat().st_size
    for step in (1, 7, 50, 333, size, 10 * size):
        found = [r["url"] for a in range(0, size, step) for b in responses.read_part(str(tmp_path), responses.FilePart("h", str(file), a, min(a + step, size)), 3) for r in b.to_pylist()]
        assert found == [f"u{i}" for i in range(40)]


def test_charset():
    assert [responses.charset(x) for x in (None, "", "text/html", 'text/html; CharSet="UTF-16"', "text/html;a=b;charset=x")] == ["utf-8", "utf-8", "utf-8", "UTF-16", "x"]


def test_response_stream(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("h", f"http://h/{i}", 0, 0.0, 200, None, {}, b"x", None) for i in range(6)]
    d = spark.createDataFrame(rows, ATTEMPTS)
    (tmp_path / "store").mkdir()
    seen = []
    for n, part in enumerate((d.limit(2), d.limit(0), d)):
        responses.write_responses(part, path, n)
        if n == 2:
            (tmp_path / "store" / "batch=7").mkdir()  # without _SUCCESS it isn't there yet
        seen.append(state.run_available(responses.response_stream(spark, path).select("url"), str(tmp_path / "out")).count())
    assert seen == [2, 2, 8] and responses.responses(spark, path).count() == 8
