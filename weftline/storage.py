"""The folder that driver and executors share, and tables written there to end the lineage of a plan."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []

#: What holds while a table is written: small Arrow batches, so that a batch of long texts stays small in memory, and
#: shuffle files that go when the table is there.
_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local folder serves
    a local session, as in tests; on a cluster it is an error, since executors and driver wouldn't see each other's
    files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="weftline-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return _OWN_DIR[0]


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The session with the settings for writing; those of the user come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, so a lost executor costs
    no recomputation, and shuffle files of what came before are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weftline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` from which everything needed has been written elsewhere."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.weftline_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has, in whatever case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
