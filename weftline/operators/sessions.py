"""Sessions: stored texts that are read in chunks, within groups.

A session table has session_id, url, grp, created_at, chunk_size, content and, derived at writing, size, total_chunks and
total_chars, so that everything but the chunks is read without the content column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.json_text import ascii_bytes, json_text
from weftline.storage import fresh


def stored(rows: DataFrame, chunk_size: int = 4000) -> DataFrame:
    """Rows (session_id, url, grp, created_at, content) with derived counts, as they are written. Content that is no text is
    stored as JSON."""
    size = F.coalesce(F.col("chunk_size"), F.lit(chunk_size)) if "chunk_size" in rows.columns else F.lit(chunk_size)
    kind = rows.schema["content"].dataType
    text = F.col("content") if isinstance(kind, T.StringType) else json_text(F.col("content"), kind)
    d = rows.withColumn("content", text).withColumn("chunk_size", size).withColumn("total_chars", F.length("content")).withColumn("size", F.octet_length("content"))
    return d.withColumn("total_chunks", F.greatest(F.ceil(F.col("total_chars") / F.col("chunk_size")), F.lit(1)).cast("int"))


def _part(group: Column) -> Column:
    """The folder of a group; those of public sessions and of a group without a name differ from all others."""
    return F.when(group.isNull(), "public").otherwise(F.concat(F.lit("of "), group))


def _bucket(session: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def write(rows: DataFrame, path: str, chunk_size: int = 4000, buckets: int = 16) -> None:
    """Append sessions to a store: a folder for each group and, in it, for each bucket of session ids. Of a store, which has
    one number of buckets, only the folders that a read needs are read."""
    d = stored(rows, chunk_size).withColumns({"part": _part(F.col("grp")), "bucket": _bucket(F.col("session_id"), buckets)})
    d.write.mode("append").partitionBy("part", "bucket").parquet(path)


def read(spark: SparkSession, path: str, scope: list[str] | None = None, ids: list[str] | None = None, buckets: int = 16) -> DataFrame:
    """The sessions of a store that a scope may open (see :func:`in_scope`), or some of them by id: other groups' folders and
    other buckets aren't read."""
    d = spark.read.option("basePath", path).parquet(path)
    if scope is not None:
        d = d.where(F.col("part").isin("public", *[f"of {g}" for g in scope])).where(in_scope(F.col("grp"), scope))
    if ids is not None:
        folders = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(_bucket(F.col("i"), buckets)).distinct().collect()]
        d = d.where(F.col("bucket").isin(*folders) & F.col("session_id").isin(*ids)) if ids else d.limit(0)
    return d


def read_chunks(spark: SparkSession, path: str, wanted: DataFrame, buckets: int = 16) -> DataFrame:
    """The chunks asked for (session_id, chunk_index) of a store. The join is by bucket too, so that Spark can leave out the
    folders of buckets that nothing is asked of."""
    d = spark.read.option("basePath", path).parquet(path)
    asked = wanted.select("session_id", "chunk_index", _bucket(F.col("session_id"), buckets).alias("bucket"))
    return _chunk_of(asked.join(d, ["bucket", "session_id"]))


def in_scope(group: Column, scope: list[str] | None) -> Column:
    """Whether a caller may open a session: without a scope all, else public ones and those of the scope's groups."""
    return F.lit(True) if scope is None else group.isNull() | group.isin(*scope)


def listed(sessions: DataFrame, groups: list[str] | None) -> DataFrame:
    """Metadata of the sessions of any of the groups, each once; without groups of all."""
    d = sessions.select("session_id", "url", "grp", "created_at", "chunk_size", "total_chunks", "total_chars", "size")
    return d if groups is None else d.where(F.col("grp").isin(*groups))


def looked_up(wanted: DataFrame, sessions: DataFrame, aliases: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Metadata of the sessions asked for (asked), by id or, where there is none, by alias (alias, session_id); contents
    aren't read. Without either the error is SESSION_NOT_FOUND, out of scope it is PERMISSION_DENIED."""
    meta = sessions.select(F.col("session_id").alias("id"), "url", "created_at", "chunk_size", "total_chunks", "total_chars", "size", F.col("grp").alias("owner"))
    named = aliases.groupBy(F.col("alias").alias("name")).agg(F.min("session_id").alias("meant"))
    direct = wanted.join(meta.select(F.col("id").alias("own")), F.col("asked") == F.col("own"), "left")
    d = direct.join(named, F.col("own").isNull() & (F.col("asked") == F.col("name")), "left").withColumn("found", F.coalesce("own", "meant"))
    d = d.join(meta, F.col("found") == F.col("id"), "left")
    error = F.when(F.col("id").isNull(), "SESSION_NOT_FOUND").when(~in_scope(F.col("owner"), scope), "PERMISSION_DENIED")
    shown = [F.when(error.isNull(), F.col(c)).alias(a) for c, a in (("id", "session_id"), ("url", "url"), ("created_at", "created_at"), ("chunk_size", "chunk_size"), ("total_chunks", "total_chunks"), ("total_chars", "total_chars"), ("size", "size"), ("owner", "grp"))]
    return d.select("asked", *shown, error.alias("error_code"))


def info(sessions: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return sessions.where(in_scope(F.col("grp"), scope)).select("session_id", "url", "created_at", "chunk_size", "total_chunks", "total_chars", "grp")


def chunks(sessions: DataFrame) -> DataFrame:
    """(session_id, chunk_index, chunk) of all chunks. A text is cut in one pass; an empty one is one empty chunk."""
    cut = F.regexp_extract_all("content", F.concat(F.lit("(?s).{1,"), F.col("chunk_size").cast("string"), F.lit("}")), F.lit(0))
    parts = F.when(F.length("content") > 0, cut).otherwise(F.array("content"))
    return sessions.select("session_id", F.posexplode(parts).alias("chunk_index", "chunk"))


def chunk(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks asked for (session_id, chunk_index); an index out of range gives null and INVALID_CHUNK_INDEX."""
    return _chunk_of(wanted.join(sessions, "session_id"))


def _chunk_of(d: DataFrame) -> DataFrame:
    good = F.col("chunk_index").between(0, F.col("total_chunks") - 1)
    return d.select(
        "session_id", "chunk_index", F.when(good, F.substring("content", F.col("chunk_index") * F.col("chunk_size") + 1, F.col("chunk_size"))).alias("chunk"),
        F.when(~good, "INVALID_CHUNK_INDEX").alias("error_code"),
    )


def joined(parts: DataFrame) -> DataFrame:
    """Chunks put together again: (session_id, content)."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk")))
    return parts.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk"]), "").alias("content"))


def whole(sessions: DataFrame, max_bytes: int = 5_242_880) -> DataFrame:
    """Contents of sessions that fit; larger ones are told by their metadata, before any content is read."""
    fits = F.col("size") <= max_bytes
    return sessions.select("session_id", F.when(fits, F.col("content")).alias("content"), F.when(~fits, "CONTENT_TOO_LARGE").alias("error_code"))


def chunk_urls(sessions: DataFrame, base: str) -> DataFrame:
    """The addresses of all chunks of each session, in order."""
    address = lambda i: F.concat(F.lit(base + "/sessions/"), F.col("session_id"), F.lit("/chunks/"), i.cast("string"))
    return sessions.select("session_id", F.transform(F.sequence(F.lit(0), F.col("total_chunks") - 1), address).alias("urls"))


def inline(rows: DataFrame, max_bytes: int = 5_242_880) -> DataFrame:
    """Rows as ``json`` and its ``bytes`` (characters beyond ASCII count as \\uXXXX escapes); where there are more than
    allowed, json is null and ``error_code`` and ``error`` tell."""
    text, size, code, error = (fresh(c, rows) for c in ("json", "bytes", "error_code", "error"))
    d = rows.withColumn(text, json_text(F.struct(*rows.columns), rows.schema)).withColumn(size, ascii_bytes(F.col(text)))
    over = F.col(size) > max_bytes
    # The error code and its text.
    told = F.concat(
        F.lit("Inline response is "), F.format_number(F.col(size).cast("long"), 0), F.lit(f" bytes, exceeding max_bytes limit of {max_bytes:,}. Use session=true to store content server-side, or increase max_bytes."),
    )
    return d.withColumns({text: F.when(~over, F.col(text)), code: F.when(over, "CONTENT_TOO_LARGE"), error: F.when(over, told)})
