"""A data source of stored HTTP responses, and the retry loop over them.

A store is a folder of batches, ``batch=<n>/host=<host>/*.json``, whose files have a JSON line for each attempt to fetch a
page: url, attempt (from 0), at, status, reason, headers, body (base64) and failure, the text of a network error if there
was no response. :func:`write_responses` writes a batch; it counts once its ``_SUCCESS`` file is there.

``spark.read.format("stored_responses").load(path)`` reads it in batch, a partition for each part of a host's file, and
``spark.readStream`` batch by batch, with the number of the last batch as offset. Files are opened by pyarrow's file
systems (local or shared folders, object stores, HDFS) where the tasks run.

Defined cases: header names are found in any case; a missing body is empty; a content type without a charset means UTF-8;
a body that isn't text in its charset, or has an unknown one, has no content and a ``decode_error``; lines that are no
JSON objects are an error; an empty store has no rows; other columns given to :func:`write_responses` are left out.
"""

from __future__ import annotations

import base64
import io
import json
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from email.message import Message
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from weftline.functions.classify import fetch_delay_seconds, retryable

SCHEMA = """host string, url string, attempt int, at double, status_code int, reason string, headers map<string,string>, content_type string,
  location string, retry_after string, encoding string, content string, failure string, decode_error string"""
_ARROW = pa.schema([
    ("host", pa.string()), ("url", pa.string()), ("attempt", pa.int32()), ("at", pa.float64()), ("status_code", pa.int32()), ("reason", pa.string()),
    ("headers", pa.map_(pa.string(), pa.string())), ("content_type", pa.string()), ("location", pa.string()), ("retry_after", pa.string()), ("encoding", pa.string()),
    ("content", pa.string()), ("failure", pa.string()), ("decode_error", pa.string()),
])


def charset(content_type: str | None) -> str:
    """The charset parameter of a content type, else UTF-8. The body is not looked at."""
    message = Message()
    message["content-type"] = content_type or "text/html"
    found = message.get_param("charset")
    return (found[2] if isinstance(found, tuple) else found) or "utf-8"


def parse_line(host: str, line: bytes) -> dict:
    """A row of the source from a line of a file."""
    raw = json.loads(line)
    headers = {str(k): str(v) for k, v in (raw.get("headers") or {}).items()}
    by_name = {k.lower(): v for k, v in headers.items()}
    encoding, content, wrong = charset(by_name.get("content-type")), None, None
    if raw.get("failure") is None:
        try:
            content = base64.b64decode(raw.get("body") or "").decode(encoding)
        except (LookupError, ValueError) as e:
            wrong = str(e)
    return {
        "host": host, "url": raw.get("url"), "attempt": raw.get("attempt") or 0, "at": raw.get("at"), "status_code": raw.get("status") or 0, "reason": raw.get("reason"), "headers": list(headers.items()),
        "content_type": by_name.get("content-type"), "location": by_name.get("location"), "retry_after": by_name.get("retry-after"), "encoding": encoding, "content": content,
        "failure": raw.get("failure"), "decode_error": wrong,
    }


@dataclass
class FilePart(InputPartition):
    """The lines of a host's file that begin in a range of its bytes."""

    host: str
    path: str
    start: int
    end: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def read_part(path: str, part: FilePart, rows: int = 256) -> Iterator[pa.RecordBatch]:
    store, _ = _opened(path)
    with io.BufferedReader(store.open_input_file(part.path), 1 << 20) as file:
        at = max(part.start - 1, 0)
        file.seek(at)
        if part.start:
            at += len(file.readline())  # the end of a line that begins before
        held: list[dict] = []
        while at < part.end and (line := file.readline()):
            at += len(line)
            if line.strip():
                held.append(parse_line(part.host, line))
            if len(held) == rows:
                yield pa.RecordBatch.from_pylist(held, _ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class _Store:
    """The files of a store, by batch and host."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("stored_responses needs a path")
        self.path, self.part_bytes = options["path"], int(options.get("partBytes", 64 << 20))
        self.hosts: set[str] | None = set(json.loads(options["hosts"])) if "hosts" in options else None

    def batches(self) -> list[int]:
        """The numbers of complete batches."""
        store, root = _opened(self.path)
        found = [x.base_name for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory and x.base_name.startswith("batch=")]
        whole = [x for x in found if store.get_file_info(f"{root}/{x}/_SUCCESS").type == fs.FileType.File]
        return sorted(int(x.removeprefix("batch=")) for x in whole)

    def parts(self, batches: Sequence[int]) -> list[FilePart]:
        store, root = _opened(self.path)
        out = []
        for n in batches:
            for folder in store.get_file_info(fs.FileSelector(f"{root}/batch={n}")):
                host = unquote(folder.base_name.removeprefix("host="))
                if folder.type != fs.FileType.Directory or not folder.base_name.startswith("host=") or self.hosts is not None and host not in self.hosts:
                    continue
                for file in store.get_file_info(fs.FileSelector(folder.path)):
                    if file.type == fs.FileType.File and not posixpath.basename(file.path).startswith(("_", ".")):
                        out += [FilePart(host, file.path, a, min(a + self.part_bytes, file.size)) for a in range(0, file.size, self.part_bytes)]
        return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.store = _Store(options)

    def partitions(self) -> list[FilePart]:
        return self.store.parts(self.store.batches())

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return read_part(self.store.path, partition)


class _StreamReader(DataSourceStreamReader):
    """Batches in the order of their numbers; a batch is read when all before it that are there are complete."""

    def __init__(self, options: dict):
        self.store = _Store(options)

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(self.store.batches(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        return self.store.parts([n for n in self.store.batches() if start["batch"] < n <= end["batch"]])

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return read_part(self.store.path, partition)


class StoredResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def responses(spark: SparkSession, path: str, hosts: list[str] | None = None) -> DataFrame:
    """All attempts of a store, or those of some hosts, whose files alone are listed and read then. The hosts are an option
    and no pushed filter, since Spark 4.1 applies a filter pushed into a Python source to later uses of the DataFrame too."""
    spark.dataSource.register(StoredResponses)
    read = spark.read.format("stored_responses")
    return (read if hosts is None else read.option("hosts", json.dumps(hosts))).load(path)


def response_stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(StoredResponses)
    return spark.readStream.format("stored_responses").load(path)


def write_responses(attempts: DataFrame, path: str, batch: int = 0, file_rows: int = 100_000) -> None:
    """Write attempts (host, url, attempt, at, status, reason, headers, body binary, failure) as a batch of a store. A host
    with many pages gets files of at most ``file_rows`` lines."""
    lines = attempts.select("host", "url", "attempt", "at", "status", "reason", "headers", F.base64("body").alias("body"), "failure")
    lines.write.mode("overwrite").partitionBy("host").option("maxRecordsPerFile", file_rows).json(f"{path}/batch={batch}")


def fetch_results(attempts: DataFrame, max_retries: int = 3, jitter: Column | None = None) -> DataFrame:
    """What fetching each address ended with: url, status_code, content, content_type, encoding, error, retry_count,
    rate_limited and waited, the seconds of all delays.

    An attempt is followed by the next one if it got no response or one that may be retried, and isn't the
    ``max_retries``-th retry; what is stored behind the attempt that ended it doesn't count, and if none did, the last
    one stored does. ``jitter`` (0 to 1) is the random part of a delay, none by default.
    """
    each = Window.partitionBy("host", "url")
    again = (F.col("failure").isNotNull() | retryable(F.col("status_code"))) & (F.col("attempt") < max_retries)
    d = attempts.withColumn("again", again)
    d = d.withColumn("last", F.coalesce(F.min(F.when(~F.col("again"), F.col("attempt"))).over(each), F.max("attempt").over(each))).where(F.col("attempt") <= F.col("last"))
    before = F.col("attempt") < F.col("last")
    # After a network error there is no header to go by.
    delay = fetch_delay_seconds(F.col("attempt"), F.when(F.col("failure").isNull(), F.col("retry_after")), F.lit(0.0) if jitter is None else jitter)
    bad, nothing = F.col("failure").isNotNull(), F.col("failure").isNotNull() | F.col("decode_error").isNotNull()
    # The texts of errors.
    reason = F.coalesce(F.nullif("reason", F.lit("")), F.lit("Unknown"))
    error = (
        F.when(bad, F.concat(F.lit("HTTP error after "), (F.col("attempt") + 1).cast("string"), F.lit(" attempts: "), "failure")).when(F.col("decode_error").isNotNull(), F.concat(F.lit("Unexpected error: "), "decode_error"))
        .when(F.col("status_code") >= 400, F.concat_ws(" ", F.lit("HTTP"), F.col("status_code").cast("string"), reason))
    )
    end = F.struct("at", F.when(nothing, 0).otherwise(F.col("status_code")).alias("status_code"), F.when(nothing, "").otherwise(F.col("content")).alias("content"), F.when(~nothing, F.col("content_type")).alias("content_type"), F.when(nothing, "utf-8").otherwise(F.col("encoding")).alias("encoding"), error.alias("error"))
    found = d.groupBy("host", "url").agg(
        F.min(F.when(~before, end)).alias("end"), F.max("last").alias("retry_count"), F.bool_or(before & (F.col("status_code") == 429)).alias("rate_limited"), F.sum(F.when(before, delay).otherwise(0.0)).alias("waited"),
    )
    return found.select("host", "url", "end.status_code", "end.content", "end.content_type", "end.encoding", "end.error", "retry_count", "rate_limited", "waited")
