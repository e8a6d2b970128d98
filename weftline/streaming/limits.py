"""Rate limits and windows over call records, in batch and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DECIDED = "event_id long, user_id long, ts timestamp, admitted boolean"


def admit(times: list[float], recent: deque, limit: int, seconds: float) -> list[bool]:
    """Whether each call is admitted, given the admitted ones before: fewer than ``limit`` in the last ``seconds``."""
    out = []
    for t in times:
        while recent and recent[0] <= t - seconds:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


def limited(calls: DataFrame, limit: int = 60, seconds: float = 60.0) -> DataFrame:
    """Calls (event_id, user_id, ts) with ``admitted``: a recurrence along each user's calls, since rejected ones don't
    count. A user's calls pass in order through a fold that holds ``limit`` times; nothing else is kept of a user."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recent = None, deque()
        for batch in batches:
            flags = []
            for who, t in zip(batch["user_id"], batch["ts"].astype("int64") / 1e9, strict=True):
                if who != user:
                    user, recent = who, deque()
                flags += admit([t], recent, limit, seconds)
            yield batch.assign(admitted=flags)[["event_id", "user_id", "ts", "admitted"]]

    ordered = calls.select("event_id", "user_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.mapInPandas(run, DECIDED)


def spacing(requests: DataFrame, delay: float = 1.0) -> DataFrame:
    """Requests (domain, ts) with the seconds to wait since the one before on the domain."""
    before = F.lag("ts").over(Window.partitionBy("domain").orderBy("ts", "event_id"))
    elapsed = (F.unix_micros("ts") - F.unix_micros(before)) / 1e6
    return requests.withColumn("wait", F.when(before.isNull(), 0.0).otherwise(F.greatest(delay - elapsed, F.lit(0.0))))


def windowed(calls: DataFrame, size: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Calls by type and tumbling window, in batch or on a stream with late calls up to a watermark."""
    d = calls.withWatermark("ts", late) if calls.isStreaming else calls
    return d.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, keys: list[str], path: str, mode: str = "update") -> DataFrame:
    """Process what there is of a stream of updates and return the result table: each batch's rows are written below
    ``path``, and of the rows of a key the last batch's count. Nothing is gathered on the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/{number:09d}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")
