"""Stateful operators on streams: an exact rate limiter, spacing of requests, and a crawl whose visited set is state.

State is kept by key with ``transformWithState``, over rows or pandas (list and value state, event-time timers), in RocksDB, whose
files are part of the query's checkpoint, so that a restarted query goes on where it stopped.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.window import Window

from weftline.operators.crawl import clamp, linked, started
from weftline.storage import materialize, shared_dir
from weftline.streaming.limits import DECIDED, admit

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that these operators need; the user's comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process what there is of an append stream and return all rows written so far: each batch's below ``path``, so that a
    batch that is run again replaces its rows. Called again with more input, the query goes on with its state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number:09d}")

    with stateful(stream.sparkSession):
        stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")


def _micros(column: pd.Series) -> list[int]:
    return column.astype("datetime64[us]").astype("int64").tolist()


# ---------------------------------------------------------------- rate limit


class Limiter(StatefulProcessor):
    """By user: the times of the admitted calls that still count, as list state. A timer clears them when event time has
    passed the last of them by the limit's span, so that users who went away hold no state."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "t double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        recent = deque(t for (t,) in self.recent.get())
        times = [t / 1e6 for t in _micros(d["ts"])]
        d["admitted"] = admit(times, recent, self.limit, self.seconds)
        if recent:
            self.recent.put([(t,) for t in recent])
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((times[-1] + self.seconds) * 1000) + 1)
        yield d[["event_id", "user_id", "ts", "admitted"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited_stream(calls: DataFrame, limit: int = 60, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """A stream of calls (event_id, user_id, ts) with ``admitted``, decided in the order in which micro-batches bring them
    and by time within one; on input in order it equals :func:`weftline.streaming.limits.limited`. Calls that are later
    than ``late`` are dropped."""
    timed = calls.select("event_id", "user_id", "ts").withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithStateInPandas(Limiter(limit, seconds), DECIDED, "Append", "EventTime")


# ---------------------------------------------------------------- spacing


def released(requests: DataFrame, delay: float = 1.0) -> DataFrame:
    """Requests (event_id, domain, ts) with ``release``: when each may start, in order, ``delay`` seconds at least after the
    one before on its domain started; ``wait`` in seconds.

    A release is the largest, over the requests up to it, of their time and the delays since: a running maximum.
    """
    step = round(delay * 1e6)
    turn = Window.partitionBy("domain").orderBy("ts", "event_id")
    d = requests.withColumns({"at": F.unix_micros("ts"), "turn": F.row_number().over(turn).cast("long") * step})
    due = F.max(F.col("at") - F.col("turn")).over(turn.rowsBetween(Window.unboundedPreceding, 0)) + F.col("turn")
    d = d.withColumn("due", due)
    return d.withColumn("release", F.timestamp_micros("due")).withColumn("wait", (F.col("due") - F.col("at")) / 1e6).drop("at", "turn", "due")


class Spacer(StatefulProcessor):
    """By domain: the last release as value state, and the requests that wait for theirs, in order, as list state. A domain
    has one timer, for the first of them; when it expires, all that the watermark has passed come out."""

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "release long")
        self.waiting = handle.getListState("waiting", "release long, event_id long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = self.last.get()
        last, new = known[0] if known else None, []
        for at, event in sorted((r.at, r.event_id) for r in rows):
            last = at if last is None else max(at, last + self.step)
            new.append((last, event, at))
        self.last.update((last,))
        if not self.waiting.exists():
            self.handle.registerTimer(-(-new[0][0] // 1000))
        self.waiting.appendList(new)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = sorted(self.waiting.get())
        due = bisect_right(waiting, now, key=lambda x: -(-x[0] // 1000))
        if due < len(waiting):
            self.waiting.put(waiting[due:])
            self.handle.registerTimer(-(-waiting[due][0] // 1000))
        else:
            self.waiting.clear()
        for release, event, at in waiting[:due]:
            yield Row(event_id=event, domain=key[0], due=release, wait=(release - at) / 1e6)

    def close(self) -> None:
        pass


def released_stream(requests: DataFrame, delay: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """A stream of requests (event_id, domain, ts) that come out (event_id, domain, release, wait) when event time, the
    watermark that is, has passed their release. Releases are those of :func:`released` on input in order."""
    timed = requests.select("event_id", "domain", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    schema = f"event_id long, domain {requests.schema['domain'].dataType.simpleString()}, due long, wait double"
    out = timed.groupBy("domain").transformWithState(Spacer(round(delay * 1e6)), schema, "Append", "EventTime")
    return out.select("event_id", "domain", F.timestamp_micros("due").alias("release"), "wait")


# ---------------------------------------------------------------- crawl


class Frontier(StatefulProcessor):
    """By crawl, as one value state: the keys that were visited (no more than a level's for each level), and the places of
    the level that is being fetched. From the pages fetched of a level come the places of the next that weren't visited."""

    def __init__(self, per_level: int):
        self.per_level = per_level

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("crawl", "visited array<string>, places array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        d = sorted(rows, key=lambda r: r.pos)
        depth, host, known = d[0].depth, d[0].start_host, self.state.get()
        visited, places = known if known else ([], [d[0].key])
        seen, wanted = set(visited), {}

        def visit(at: int) -> None:
            for place in places[len(done) : at]:
                done.append(place)
                seen.add(place)

        done: list[str] = []
        for r in d:
            visit(r.pos + 1)  # places that lead nowhere were visited too
            if r.host == host:
                wanted.update({(x["link"], x["key"]): None for x in r.out if x["key"] not in seen})
        visit(len(places))
        following = [k for _, k in wanted][: self.per_level]
        self.state.update((sorted(seen), following))
        for pos, k in enumerate(following):
            if k not in seen and following.index(k) == pos:
                yield Row(crawl_id=key[0], start_host=host, depth=depth + 1, pos=pos, key=k)

    def close(self) -> None:
        pass


def crawl_by_stream(seeds: DataFrame, pages: DataFrame, depth: int = 3, per_level: int = 5) -> DataFrame:
    """The pages of :func:`weftline.operators.crawl.crawl` from a stream that feeds itself: fetched pages come in, a
    stateful operator gives the places of the next level that weren't visited, and these, joined with the page table,
    are appended to the input. A level is a run over what there is of the stream; state lasts from run to run."""
    depth, per_level = clamp(depth, 1, 3), clamp(per_level, 1, 20)
    spark, path = seeds.sparkSession, f"{shared_dir(seeds.sparkSession)}/crawl-{uuid.uuid4().hex}"
    known = materialize(linked(pages.select("url", "links"), per_level), "crawl-pages")
    crawl_type = seeds.schema["crawl_id"].dataType.simpleString()
    columns = ["crawl_id", "start_host", "depth", "pos", "key", "page_url", "host", "out"]
    first = started(seeds).withColumns({"depth": F.lit(1), "pos": F.lit(0)}).join(known, "key").select(*columns)
    first.write.parquet(f"{path}/fetched/level=1")
    if depth > 1:
        source = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(f"{path}/fetched")
        found = source.groupBy("crawl_id").transformWithState(Frontier(per_level), f"crawl_id {crawl_type}, start_host string, depth int, pos int, key string", "Append", "None")
        for level in range(2, depth + 1):
            frontier = run_available(found, path).where(F.col("depth") == level)
            frontier.join(known, "key").select(*columns).write.mode("overwrite").parquet(f"{path}/fetched/level={level}")
    fetched = spark.read.schema(first.schema).option("recursiveFileLookup", "true").parquet(f"{path}/fetched")
    seq = F.when(F.col("depth") == 1, 0).when(F.col("depth") == 2, F.col("pos") + 1).otherwise(per_level + F.col("pos") + 1)
    return fetched.select("crawl_id", seq.cast("int").alias("seq"), "depth", F.col("page_url").alias("url"))
