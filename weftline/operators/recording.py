"""Recording of pages: obfuscated copies under a name for files, their manifest, and totals; and simulation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.obfuscate import obfuscate
from weftline.functions.text import slug
from weftline.sources.readers import fetched, write_json, write_pages
from weftline.storage import discard, materialize


def record(results: DataFrame) -> DataFrame:
    """Fetch results (url, status_code, error, content_type, content) with slug, path, obfuscated html and its size;
    failed fetches keep their row without html."""
    d = fetched(results).withColumn("slug", slug(F.col("url")))
    d = d.withColumn("html", F.when(F.col("success"), obfuscate(F.col("content"))))
    return d.select("slug", "url", F.concat("slug", F.lit("/index.html")).alias("path"), "content_type", "status_code", "success", "html", F.octet_length("html").alias("size_bytes"))


def totals(recorded: DataFrame) -> DataFrame:
    """One row: attempted, recorded, failed, bytes."""
    return recorded.agg(
        F.count("*").alias("attempted"), F.count_if("success").alias("recorded"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
    )


def site_manifests(recorded: DataFrame, recorded_at: str, version: int = 1) -> DataFrame:
    """A row for each site in the shape of a recording manifest, with its files by path. Rows that agree in site, path and
    result are one file."""
    file = F.struct("path", "content_type", F.col("status_code").alias("original_status"), F.col("size_bytes").cast("bigint").alias("size_bytes"), F.lit(True).alias("obfuscated"))
    sites = recorded.where("success").groupBy("slug", F.col("url").alias("original_url")).agg(F.array_sort(F.collect_set(file)).alias("files"))
    return sites.select(F.lit(version).alias("version"), F.lit(recorded_at).alias("recorded_at"), F.array(F.struct("slug", "original_url", "files")).alias("sites"))


def manifest(recorded: DataFrame, recorded_at: str, version: int = 1) -> DataFrame:
    """All sites as one manifest, for a recording that is small enough to be a single document."""
    sites = site_manifests(recorded, recorded_at, version)
    return sites.groupBy("version", "recorded_at").agg(F.array_sort(F.flatten(F.collect_list("sites"))).alias("sites"))


def write(recorded: DataFrame, recorded_at: str, path: str) -> None:
    """Pages, and a manifest line for each site, written by all tasks. Pages are obfuscated once, for both."""
    done = materialize(recorded.where("success"), "recorded")
    write_pages(done.select("slug", "html"), f"{path}/pages")
    write_json(site_manifests(done, recorded_at), f"{path}/manifest")
    discard(done)


def simulation_report(config: DataFrame, result: DataFrame) -> DataFrame:
    """One row each of a run's configuration and result as one JSON document."""
    whole = config.select(F.struct(*config.columns).alias("config"), F.lit(1).alias("one")).join(result.select(F.struct(*result.columns).alias("result"), F.lit(1).alias("one")), "one")
    return whole.select(F.to_json(F.struct("config", "result")).alias("report"))


def check_options(timeout: float | None = None, delay: float | None = None, max_chars: int | None = None) -> None:
    """Raise for options of a crawl that make no sense."""
    if timeout is not None and not timeout > 0:
        raise ValueError("timeout must be positive")
    if delay is not None and not delay >= 0:
        raise ValueError("delay must not be negative")
    if max_chars is not None and not 4000 <= max_chars <= 4_000_000:
        raise ValueError("max_chars must be between 4000 and 4000000")
