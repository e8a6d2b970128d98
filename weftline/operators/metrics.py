"""Call metrics: overall, by tool, and by tool and persona, in one pass.

Calls: tool_name string, persona string, duration_ms int, success boolean, error_type string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.storage import fresh, materialize

CALLS_SCHEMA = "tool_name string, persona string, duration_ms int, success boolean, error_type string"
RESERVOIR = 5000


def _clamped(calls: DataFrame) -> DataFrame:
    return calls.withColumn("ms", F.greatest("duration_ms", F.lit(0))).withColumn("persona", F.coalesce("persona", F.lit("default"))).withColumn("failed", ~F.coalesce("success", F.lit(False)))


def percentiles(counts: DataFrame, keys: list[str], value: str, n: str, shares: list[float]) -> DataFrame:
    """(keys, p) of a table of values and how often each key has them: exact percentiles, linear between ranks, as an array.

    Ranks are selected by ranges: Spark's range partitioning, by splitters that it samples, orders values by key over all
    tasks; how many rows a key has in each range tells at which rank the range begins, and only the values at the ranks
    wanted are kept. No task holds more than its range, however many values a key has.
    """
    part, begin, size, low = (fresh(c, counts) for c in ("part", "begin", "size", "low"))
    same = lambda a, b: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    ranged = counts.where(F.col(value).isNotNull()).repartitionByRange(*keys, value).withColumn(part, F.spark_partition_id())
    ranged = materialize(ranged, "percentile-ranges")
    sizes = ranged.groupBy(*keys, part).agg(F.sum(n).alias(size))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(begin, F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn(size, F.sum(size).over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(part, *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn(low, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    placed = local.alias("a").join(starts.alias("b"), [*same("a", "b"), F.col(f"a.{part}") == F.col(f"b.{part}")]).select("a.*", f"b.{size}", f"b.{begin}").withColumn(low, F.col(low) + F.col(begin))
    # A value has the ranks from low to low + n - 1; a share's place between two ranks is (size - 1) * share.
    place = lambda q: F.lit(q) * (F.col(size) - 1)
    at = lambda rank: F.max(F.when((rank >= F.col(low)) & (rank < F.col(low) + F.col(n)), F.col(value)))
    ends = [x for q in shares for x in (at(F.floor(place(q))).cast("double"), at(F.ceil(place(q))).cast("double"))]
    picked = placed.groupBy(*keys).agg(F.max(size).alias(size), F.array(*ends).alias("ends"))
    between = [F.get("ends", F.lit(2 * i)) + (F.get("ends", F.lit(2 * i + 1)) - F.get("ends", F.lit(2 * i))) * (place(q) - F.floor(place(q))) for i, q in enumerate(shares)]
    return picked.select(*keys, F.array(*between).alias("p"))


def report(calls: DataFrame) -> DataFrame:
    """level, tool_name, persona, counts, latencies and their percentiles (linear between ranks), error rate in percent.

    Percentiles are exact, over all calls; ``sample_size`` tells how many a bounded reservoir would have kept. Calls are
    counted by tool, persona and latency once, and all levels are made of these counts.
    """
    d = _clamped(calls).groupBy("tool_name", "persona", "ms").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("errors"))
    d = materialize(d, "latencies")
    sets = [[], [d["tool_name"]], [d["tool_name"], d["persona"]]]
    keys = ["gid", "tool_name", "persona"]
    grouped = d.groupingSets(sets, d["tool_name"], d["persona"]).agg(
        F.grouping_id().cast("int").alias("gid"), F.sum("n").alias("count"), F.sum("errors").alias("error_count"), F.sum(F.col("ms").cast("long") * F.col("n")).alias("sum_ms"),
        F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
    )
    every = d.groupingSets([[*x, d["ms"]] for x in sets], d["tool_name"], d["persona"], d["ms"]).agg(F.grouping_id().alias("g"), F.sum("n").alias("n"))
    shares = percentiles(every.select(F.shiftright("g", 1).cast("int").alias("gid"), "tool_name", "persona", "ms", "n"), keys, "ms", "n", [0.5, 0.95, 0.99])
    joined = grouped.alias("a").join(shares.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select("a.*", "b.p")
    return joined.where("count > 0").select(
        F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "tool").otherwise("tool_persona").alias("level"), "tool_name", "persona", "count", "error_count",
        F.round(100.0 * F.col("error_count") / F.col("count"), 2).alias("error_rate"), "sum_ms", "min_ms", "max_ms", (F.col("sum_ms") / F.col("count")).alias("mean_ms"),
        F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"), F.get("p", F.lit(2)).alias("p99"), F.least("count", F.lit(RESERVOIR)).alias("sample_size"),
    )


def error_histogram(calls: DataFrame) -> DataFrame:
    """(tool_name, error_type, n) of failed calls; a missing type is unknown."""
    return _clamped(calls).where("failed").groupBy("tool_name", F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("n"))


def error_maps(calls: DataFrame) -> DataFrame:
    """The histogram as a map for each tool."""
    pairs = F.collect_list(F.struct("error_type", "n"))
    return error_histogram(calls).groupBy("tool_name").agg(F.map_from_entries(F.array_sort(pairs)).alias("error_types"))


def counters(calls: DataFrame) -> DataFrame:
    """One row: calls that went well and that failed."""
    return _clamped(calls).agg(F.count_if(~F.col("failed")).alias("ok"), F.count_if("failed").alias("error"))


def sampled(calls: DataFrame, k: int = RESERVOIR, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """A seeded uniform sample of ``k`` calls, of each group ``by`` if that is given (the sampling operator; reports don't
    need it). A group is sampled in salted parts first, so that a large one is no single task's work."""
    u = fresh("u", calls)
    d = calls.withColumn(u, F.rand(seed))
    if not by:
        return d.orderBy(u).limit(k).drop(u)
    salt, turn = fresh("salt", calls), fresh("turn", calls)
    least = lambda x, keys: x.withColumn(turn, F.row_number().over(Window.partitionBy(*keys).orderBy(u))).where(F.col(turn) <= k).drop(turn)
    parts = least(d.withColumn(salt, F.pmod(F.xxhash64(u), F.lit(64))), [*by, salt])
    return least(parts.drop(salt), by).drop(u)


def throughput(runs: DataFrame) -> DataFrame:
    """Runs (started, ended in seconds, requests) with duration (not negative) and requests a second, 0 without duration."""
    d = runs.withColumn("duration", F.greatest(F.col("ended") - F.col("started"), F.lit(0.0)))
    return d.withColumn("rps", F.coalesce(F.try_divide("requests", "duration"), F.lit(0.0)))


def nested(calls: DataFrame) -> DataFrame:
    """The report as one JSON document: overall, by_tool and by_tool_persona with keys tool::persona."""
    d = report(calls).withColumn("body", F.struct("count", "error_count", "error_rate", "min_ms", "max_ms", "mean_ms", "p50", "p95", "p99", "sample_size"))
    key = F.when(F.col("level") == "overall", "overall").when(F.col("level") == "tool", F.col("tool_name")).otherwise(F.concat_ws("::", "tool_name", "persona"))
    parts = d.groupBy().pivot("level", ["overall", "tool", "tool_persona"]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.to_json("body").alias("v"))))))
    return parts.select(F.to_json(F.struct("overall", F.col("tool").alias("by_tool"), F.col("tool_persona").alias("by_tool_persona"))).alias("report"))
