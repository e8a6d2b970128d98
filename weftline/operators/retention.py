"""Retention: what a size or age limit deletes, and storage figures.

Items: guid, created_at string, size long, grp string, has_metadata boolean, and scope, the store they are in. An item
without metadata (an orphan) counts towards the total but is never deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from weftline.storage import discard, materialize

MB = 1_048_576


def prune_plan(items: DataFrame, max_bytes: float) -> DataFrame:
    """Items with ``deleted``: the oldest of each scope go, in order of created_at, guid and size, while the rest exceeds
    the limit. The running sum is taken in two levels, by day and within a day, so that no task orders a whole scope."""
    day = F.coalesce(F.left("created_at", F.lit(10)), F.lit(""))
    d = items.withColumn("created_at", F.coalesce("created_at", F.lit(""))).withColumn("day", day).withColumn("kept_size", F.coalesce("size", F.lit(0)))
    days = d.groupBy("scope", "day").agg(F.sum("kept_size").alias("all"), F.sum(F.when(F.col("has_metadata"), F.col("kept_size")).otherwise(0)).alias("own"))
    upto = Window.partitionBy("scope").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    totals = days.select("scope", "day", F.sum("all").over(Window.partitionBy("scope")).alias("total"), F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("before_day"))
    inside = Window.partitionBy("scope", "day").orderBy("has_metadata", "created_at", "guid", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("has_metadata"), F.col("kept_size")).otherwise(0)
    d = d.withColumn("before", F.coalesce(F.sum(own).over(inside), F.lit(0))).join(totals, ["scope", "day"])
    gone = F.col("has_metadata") & (F.col("total") - F.col("before_day") - F.col("before") > max_bytes)
    return d.withColumn("deleted", gone).drop("day", "kept_size", "before", "before_day", "total")


def prune_summary(plan: DataFrame, max_bytes: float) -> DataFrame:
    """By scope: bytes before and after, items deleted, orphans, and the exit code (1 if still over the limit)."""
    size = F.coalesce("size", F.lit(0))
    d = plan.groupBy("scope").agg(
        F.sum(size).alias("bytes_before"), F.sum(F.when(~F.col("deleted"), size).otherwise(0)).alias("bytes_after"), F.count_if("deleted").alias("deleted"),
        F.count_if(~F.col("has_metadata")).alias("orphans"), F.sum(F.when(~F.col("has_metadata"), size).otherwise(0)).alias("orphan_bytes"),
    )
    return d.withColumn("exit_code", F.when(F.col("bytes_after") > max_bytes, 1).otherwise(0))


def exit_code(max_mb: float, stale_seconds: float, lock_age: float | None) -> int | None:
    """1 for a bad limit or stale setting, 2 while another run holds a fresh lock, else None: go on."""
    if not 0 < max_mb < float("inf") or not stale_seconds > 0:
        return 1
    return 2 if lock_age is not None and lock_age < stale_seconds else None


def purge(items: DataFrame, now: str, age_days: int, group: str | None = None) -> DataFrame:
    """Survivors of a deletion by age; 0 days means everything in scope."""
    old = F.lit(True) if age_days == 0 else F.to_timestamp("created_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(age_days))
    scoped = F.lit(True) if group is None else F.col("grp").eqNullSafe(F.lit(group))
    return items.where(~F.coalesce(old & scoped, F.lit(False)))


def delete(spark: SparkSession, path: str, doomed: DataFrame, keys: list[str], parts: list[str]) -> None:
    """Delete rows from a Parquet table at ``path`` that is partitioned by ``parts``: those that agree with a row of
    ``doomed`` (keys and parts, none of them null) in all of these.

    Only partitions that lose something are rewritten. Their survivors are written elsewhere first, so that a run that
    breaks off can be repeated; then they replace the partitions, and partitions without survivors are removed.
    """
    gone = materialize(doomed.select(*keys, *parts).distinct(), "doomed")
    touched = gone.select(*parts).distinct()
    table = spark.read.option("basePath", path).parquet(path)
    before = table.join(touched, parts, "left_semi")
    survivors = materialize(before.join(gone, [*keys, *parts], "left_anti"), "survivors")
    # Folders, not rows: as many as partitions will be empty.
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
    empty = table.select(folder, *parts).distinct().join(touched, parts, "left_semi").join(survivors.select(*parts).distinct(), parts, "left_anti")
    empty = [r["folder"] for r in empty.select("folder").collect()]
    setting = "spark.sql.sources.partitionOverwriteMode"
    before_mode = spark.conf.get(setting, None)
    spark.conf.set(setting, "dynamic")
    try:
        survivors.write.mode("overwrite").partitionBy(*parts).parquet(path)
    finally:
        spark.conf.unset(setting) if before_mode is None else spark.conf.set(setting, before_mode)
    for x in empty:
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(x))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    discard(gone, survivors)


def orphans(blobs: DataFrame, meta: DataFrame) -> DataFrame:
    """Blobs (guid, size) without metadata."""
    return blobs.join(meta, "guid", "left_anti")


def stats(items: DataFrame) -> DataFrame:
    """By scope and group (none if missing): items and bytes; ``n_groups`` of the scope. Orphans count in no group."""
    d = items.where("has_metadata").groupBy("scope", F.coalesce("grp", F.lit("none")).alias("grp")).agg(F.count("*").alias("items"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    return d.withColumn("n_groups", F.count("*").over(Window.partitionBy("scope")))


def keep_within(ticks: DataFrame, read: Callable[[], DataFrame], max_bytes: float, delete: Callable[[DataFrame], None]) -> DataStreamWriter:
    """The retention loop: each batch of a stream of ticks, e.g. a rate source, plans on the items as they are then and
    hands what must go to ``delete``. To be started with a trigger of the interval wanted."""

    def cycle(_: DataFrame, number: int) -> None:
        delete(prune_plan(read(), max_bytes).where("deleted"))

    return ticks.writeStream.foreachBatch(cycle)
