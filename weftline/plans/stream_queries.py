"""Queries of stored responses, stateful streams, networks, table functions, stores and deletion, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import tables
from weftline.operators import networks, retention, sessions
from weftline.plans.web_queries import _ITEMS, _graph, _items, _sessions, _table
from weftline.plans.web_queries import ORACLES as _WEB_ORACLES
from weftline.sources import responses
from weftline.storage import shared_dir
from weftline.streaming import limits, state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# ---------------------------------------------------------------- stored responses

#: By page and attempt: up to three attempts fail before the last one, some without a response.
_STATUS = """CASE WHEN a < page_id % 4 THEN CASE (page_id + a) % 3 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 0 END WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 7 = 1 THEN 500 ELSE 200 END"""
_TYPE = """CASE WHEN page_id % 50 = 7 THEN 'text/html; charset=nope' WHEN page_id % 3 = 0 THEN 'text/html; charset=utf-8' WHEN page_id % 3 = 1 THEN 'text/html; Charset="ISO-8859-1"' END"""
_AFTER = "CASE WHEN (page_id + a) % 3 = 0 THEN CASE page_id % 2 WHEN 0 THEN '45' ELSE 'soon' END END"


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as one to four attempts to fetch it."""
    p = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    p = p.withColumn("a", F.explode(F.expr("sequence(0, cast(page_id % 4 as int))"))).withColumns({"status": F.expr(_STATUS), "kind": F.expr(_TYPE), "after": F.expr(_AFTER)})
    latin = F.encode(F.regexp_replace("html", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    headers = F.map_filter(F.create_map(F.lit("Content-Type"), F.col("kind"), F.lit("retry-After"), F.col("after")), lambda k, v: v.isNotNull())
    return p.select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.concat("url", F.lit("?p="), F.col("page_id").cast("string")).alias("url"), F.col("a").cast("int").alias("attempt"), F.col("a").cast("double").alias("at"),
        F.col("status").cast("int").alias("status"), F.when(F.col("status") == 404, "Not Found").alias("reason"), headers.alias("headers"), F.when(F.col("page_id") % 3 == 1, latin).otherwise(F.encode("html", "UTF-8")).alias("body"),
        F.when(F.col("status") == 0, F.concat(F.lit("reset "), F.col("a").cast("string"))).alias("failure"), "page_id",
    )


_SENT = rf"""sent AS (SELECT *, {_STATUS} AS status, {_TYPE} AS kind, {_AFTER} AS after, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url || '?p=' || CAST(page_id AS VARCHAR) AS address,
  CASE WHEN page_id % 3 = 1 THEN regexp_replace(html, '[^\x00-\xFF]', '?', 'g') ELSE html END AS told FROM (SELECT *, unnest(range(0, page_id % 4 + 1)) AS a FROM pages))"""


def _stored(spark: SparkSession, sf_dir: str, batches: int = 1) -> str:
    path, attempts = f"{shared_dir(spark)}/responses-{uuid.uuid4().hex}", _attempts(spark, sf_dir)
    for n in range(batches):
        responses.write_responses(attempts.where(F.col("page_id") % batches == n), path, n)
    return path


@_query(f"""WITH {_SENT} SELECT host, address AS url, CAST(a AS INTEGER) AS attempt, CAST(status AS INTEGER) AS status_code, CASE WHEN status <> 0 AND page_id % 50 <> 7 THEN md5(told) END AS digest,
  CASE WHEN page_id % 50 = 7 THEN 'nope' WHEN page_id % 3 = 1 THEN 'ISO-8859-1' ELSE 'utf-8' END AS encoding, after AS retry_after FROM sent""")
def response_attempts(spark, sf_dir):
    d = responses.responses(spark, _stored(spark, sf_dir))
    return d.select("host", "url", "attempt", "status_code", F.md5(F.col("content").cast("binary")).alias("digest"), "encoding", "retry_after")


@_query(f"""WITH {_SENT}, d AS (SELECT *, CASE WHEN a < page_id % 4 THEN least(coalesce(CASE WHEN status <> 0 THEN TRY_CAST(after AS DOUBLE) END, CAST(pow(2, a) AS DOUBLE)), 30.0::DOUBLE) ELSE 0.0::DOUBLE END AS delay FROM sent),
  t AS (SELECT page_id, CAST(sum(delay) AS DOUBLE) AS waited, bool_or(a < page_id % 4 AND status = 429) AS rate_limited FROM d GROUP BY page_id)
  SELECT host, address AS url, CAST(CASE WHEN page_id % 50 = 7 THEN 0 ELSE status END AS INTEGER) AS status_code, CASE WHEN page_id % 50 = 7 THEN md5('') ELSE md5(told) END AS digest,
    CASE WHEN page_id % 50 = 7 THEN 'Unexpected error: unknown encoding: nope' WHEN status = 404 THEN 'HTTP 404 Not Found' WHEN status >= 400 THEN 'HTTP ' || CAST(status AS VARCHAR) || ' Unknown' END AS error,
    CAST(a AS INTEGER) AS retry_count, rate_limited, waited FROM sent JOIN t USING (page_id) WHERE a = page_id % 4""")
def response_fetches(spark, sf_dir):
    d = responses.fetch_results(responses.responses(spark, _stored(spark, sf_dir)))
    return d.select("host", "url", "status_code", F.md5(F.col("content").cast("binary")).alias("digest"), "error", "retry_count", "rate_limited", "waited")


@_query(f"""WITH {_SENT} SELECT host, CAST(status AS INTEGER) AS status_code, count(*) AS n, CAST(sum(CASE WHEN status <> 0 AND page_id % 50 <> 7 THEN length(told) END) AS BIGINT) AS chars FROM sent GROUP BY ALL""")
def response_stream(spark, sf_dir):
    # The second half of the pages arrives when the first has been read: the stream goes on behind its last batch.
    path, attempts = f"{shared_dir(spark)}/responses-{uuid.uuid4().hex}", _attempts(spark, sf_dir)
    counts = responses.response_stream(spark, path).groupBy("host", "status_code").agg(F.count("*").alias("n"), F.sum(F.length("content").cast("long")).alias("chars"))
    for n in (0, 1):
        responses.write_responses(attempts.where(F.col("page_id") % 2 == n), path, n)
        found = limits.run_available(counts, ["host", "status_code"], f"{path}-counts")
    return found


# ---------------------------------------------------------------- stateful streams


def _in_turn(spark: SparkSession, sf_dir: str, columns: dict, stream) -> DataFrame:
    """The rows that ``stream`` makes of the events, which arrive in three parts by time; state lasts from part to part."""
    e = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).alias(a) for c, a in columns.items()])
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    found = None
    for n, (low, high) in enumerate((("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01"))):
        e.where((F.col("ts") >= F.lit(low).cast("timestamp")) & (F.col("ts") < F.lit(high).cast("timestamp"))).write.parquet(f"{path}/in/part={n}")
        source = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        found = state.run_available(stream(source), path)
    return found


@_query(_WEB_ORACLES["rate_limit_exact"])
def rate_limit_stream(spark, sf_dir):
    return _in_turn(spark, sf_dir, {"event_id": "event_id", "user_id": "user_id"}, lambda s: state.limited_stream(s, 3, 3600.0)).select("event_id", "user_id", "admitted")


_DUE = """e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 7200000000 AS turn FROM events),
  r AS (SELECT *, max(t - turn) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + turn AS due FROM e)"""


@_query(f"WITH {_DUE} SELECT event_id, due AS release_us, (due - t) / 1000000.0::DOUBLE AS wait FROM r")
def spacing_release(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("domain"), F.col("ts").cast("timestamp").alias("ts"))
    return state.released(e, 7200.0).select("event_id", F.unix_micros("release").alias("release_us"), "wait")


@_query(f"""WITH {_DUE} SELECT event_id, due AS release_us, (due - t) / 1000000.0::DOUBLE AS wait FROM r WHERE (due + 999) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 60000 FROM events)""")
def spacing_stream(spark, sf_dir):
    # What is due a minute before the last event, the watermark, has come out.
    d = _in_turn(spark, sf_dir, {"event_id": "event_id", "user_id": "domain"}, lambda s: state.released_stream(s, 7200.0, "1 minute"))
    return d.select("event_id", F.unix_micros("release").alias("release_us"), "wait")


@_query(_WEB_ORACLES["crawl_bfs"])
def crawl_stream(spark, sf_dir):
    return state.crawl_by_stream(*_graph(spark, sf_dir))


# ---------------------------------------------------------------- networks

#: A network for each supplier, of one of five lengths, and an address for each customer; both engines read them so.
_NETWORK = """CASE s_suppkey % 5 WHEN 0 THEN '10.' || CAST(s_suppkey % 64 AS {text}) || '.0.0/16' WHEN 1 THEN '10.' || CAST(s_suppkey % 64 AS {text}) || '.9.9/10' WHEN 2 THEN '10.1.' || CAST(s_suppkey % 256 AS {text}) || '.128/25'
  WHEN 3 THEN '10.2.3.' || CAST(s_suppkey % 256 AS {text}) ELSE '2001:db8:' || CAST(s_suppkey % 10 AS {text}) || '::/48' END"""
_ADDRESS = """CASE c_custkey % 4 WHEN 0 THEN '10.' || CAST(c_custkey % 100 AS {text}) || '.7.8' WHEN 1 THEN '10.1.' || CAST(c_custkey % 256 AS {text}) || '.' || CAST(c_custkey % 200 AS {text}) WHEN 2 THEN '10.2.3.' || CAST(c_custkey % 256 AS {text})
  ELSE '2001:DB8:' || CAST(c_custkey % 12 AS {text}) || ':0::' || CAST(c_custkey % 7 AS {text}) END"""


@_query(rf"""WITH n AS (SELECT DISTINCT {_NETWORK.format(text="VARCHAR")} AS network FROM supplier), a AS (SELECT c_custkey, {_ADDRESS.format(text="VARCHAR")} AS address FROM customer),
  f AS (SELECT network, CASE WHEN contains(network, '/') THEN CAST(string_split(network, '/')[2] AS INTEGER) ELSE 32 END AS len, list_transform(string_split(string_split(network, '/')[1], '.'), lambda x: CAST(x AS BIGINT)) AS p FROM n WHERE NOT contains(network, ':')),
  b AS (SELECT c_custkey, list_transform(string_split(address, '.'), lambda x: CAST(x AS BIGINT)) AS p FROM a WHERE NOT contains(address, ':')),
  g AS (SELECT network, len, (p[1] * 16777216 + p[2] * 65536 + p[3] * 256 + p[4]) >> (32 - len) AS k FROM f), h AS (SELECT c_custkey, p[1] * 16777216 + p[2] * 65536 + p[3] * 256 + p[4] AS v FROM b),
  four AS (SELECT c_custkey, arg_max(network, len) AS matched FROM h JOIN (SELECT len, k, min(network) AS network FROM g GROUP BY len, k) g ON v >> (32 - len) = k GROUP BY c_custkey),
  six AS (SELECT c_custkey, network AS matched FROM a JOIN n ON contains(address, ':') AND starts_with(lower(address), string_split(network, '::')[1] || ':'))
  SELECT c_custkey, address, coalesce(four.matched, six.matched) AS matched FROM a LEFT JOIN four USING (c_custkey) LEFT JOIN six USING (c_custkey)""")
def network_match(spark, sf_dir):
    known = _table(spark, sf_dir, "supplier").select(F.expr(_NETWORK.format(text="STRING")).alias("network")).distinct()
    asked = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_ADDRESS.format(text="STRING")).alias("address"))
    return networks.longest_match(asked, known)


# ---------------------------------------------------------------- table functions, stores and deletion


@_query(r"""WITH d AS (SELECT doc_id, text, doc_id % 300 + 100 AS size FROM documents WHERE text IS NOT NULL), c AS (SELECT *, unnest(range(0, CAST(greatest(ceil(length(text) / CAST(size AS DOUBLE)), 1) AS BIGINT))) AS i FROM d)
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, i * size + 1, size)) AS digest FROM c""")
def chunks_by_sql(spark, sf_dir):
    tables.register(spark)
    return spark.sql("SELECT doc_id, chunk_index, md5(cast(chunk AS BINARY)) AS digest FROM {d}, LATERAL split_chunks(text, cast(doc_id % 300 + 100 AS INT))", d=_table(spark, sf_dir, "documents").select("doc_id", "text"))


_LINES = ("User-agent: *", "Disallow: /n", "# note", "Crawl-delay: 2", "User-agent: b", "Allow: /x", "User-agent: *", "Disallow: /last")


@_query("""WITH n AS (SELECT 'h' || CAST(s_suppkey AS VARCHAR) AS host, s_suppkey % 9 AS k FROM supplier), r(agent, agent_seq, crawl_delay, rule_seq, path, allow, low, high) AS (VALUES
  ('*', 0, NULL, 0, '/n', false, 2, 3), ('*', 0, 2.0::DOUBLE, 0, '/n', false, 4, 7), ('*', 0, NULL, 0, '/last', false, 8, 8), ('b', 1, NULL, 0, '/x', true, 6, 8))
  SELECT host, agent, agent_seq, crawl_delay, rule_seq, path, allow FROM n JOIN r ON k BETWEEN low AND high""")
def robots_by_sql(spark, sf_dir):
    """Robots files of which each host has the first lines, as many as its number modulo 9."""
    tables.register(spark)
    lines = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("host"), (F.col("s_suppkey") % 9).alias("k"), F.posexplode(F.array(*map(F.lit, _LINES))).alias("line_no", "line"))
    return spark.sql("SELECT * FROM robots_rules(TABLE({lines}))", lines=lines.where("line_no < k").select("host", "line_no", "line"))


@_query("""WITH s AS (SELECT 's' || CAST(doc_id AS VARCHAR) AS session_id, CASE WHEN doc_id % 4 <> 0 THEN source END AS grp, text FROM documents), w AS (SELECT *, unnest([0, 2]) AS i FROM s)
  SELECT session_id, CAST(i AS INTEGER) AS chunk_index, CASE WHEN i < greatest(ceil(length(text) / 500.0), 1) THEN md5(substr(text, CAST(i * 500 + 1 AS BIGINT), 500)) END AS digest FROM w WHERE grp IS NULL OR grp IN ('src1', 'src3')""")
def session_store(spark, sf_dir):
    """Chunks of what a scope may open, from a store of sessions by group and bucket."""
    d, path = _table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    rows = d.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"), F.lit("u").alias("url"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("grp"), F.lit("2026-01-01").alias("created_at"), F.col("text").alias("content"))
    sessions.write(rows, path, 500)
    wanted = sessions.read(spark, path, ["src1", "src3"]).select("session_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("chunk_index"))
    return sessions.read_chunks(spark, path, wanted).select("session_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@_query("""WITH w AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 's' WHEN 1 THEN 'alias-' ELSE 'none-' END || CAST(doc_id AS VARCHAR) AS asked, doc_id % 4 <> 0 AS owned FROM documents),
  e AS (SELECT *, CASE WHEN doc_id % 3 = 2 THEN 'SESSION_NOT_FOUND' WHEN owned AND source NOT IN ('src1', 'src2') THEN 'PERMISSION_DENIED' END AS error_code FROM w)
  SELECT asked, CASE WHEN error_code IS NULL THEN 's' || CAST(doc_id AS VARCHAR) END AS session_id, CASE WHEN error_code IS NULL AND owned THEN source END AS grp, error_code FROM e""")
def session_lookup(spark, sf_dir):
    d = _sessions(spark, sf_dir)
    number = F.substring("session_id", 2, 100)
    aliases = d.select(F.concat(F.lit("alias-"), number).alias("alias"), "session_id")
    wanted = d.select(F.concat(F.when(number.cast("long") % 3 == 0, "s").when(number.cast("long") % 3 == 1, "alias-").otherwise("none-"), number).alias("asked"))
    return sessions.looked_up(wanted, d, aliases, ["src1", "src2"]).select("asked", "session_id", "grp", "error_code")


@_query(f"""WITH {_ITEMS}, r AS (SELECT *, sum(size) OVER (PARTITION BY scope) AS total, coalesce(sum(CASE WHEN has_metadata THEN size ELSE 0 END) OVER (PARTITION BY scope ORDER BY created_at, has_metadata, guid, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM item) SELECT guid, scope, size, grp FROM r WHERE NOT (has_metadata AND total - before > 30000)""")
def retention_delete(spark, sf_dir):
    """What is left in a stored table when what the limit deletes has been deleted from its files."""
    path = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    _items(spark, sf_dir).write.partitionBy("scope").parquet(path)
    stored = spark.read.parquet(path)
    retention.delete(spark, path, retention.prune_plan(stored, 30000).where("deleted"), ["guid"], ["scope"])
    return spark.read.parquet(path).select("guid", "scope", "size", "grp")


@_query("""WITH j AS (SELECT doc_id, '{"doc_id": ' || CAST(doc_id AS VARCHAR) || ', "lang": ' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || lang || '"' END || ', "score": ' || CASE doc_id % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '12345678.25' WHEN 2 THEN '1e-07' ELSE '2.5e+20' END
  || ', "tags": [1, null, ' || CAST(CAST(doc_id % 2 = 0 AS INTEGER) AS VARCHAR) || '], "note": {"é\\"": "' || repeat('é', CAST(doc_id % 40 AS INT)) || '"}}' AS json, 5 * (doc_id % 40 + 1) AS more FROM documents WHERE lang IS NOT NULL),
  b AS (SELECT *, length(json) + more AS bytes FROM j)
  SELECT doc_id, CAST(bytes AS INT) AS bytes, CASE WHEN bytes <= 240 THEN json END AS json, CASE WHEN bytes > 240 THEN 'CONTENT_TOO_LARGE' END AS error_code,
    CASE WHEN bytes > 240 THEN 'Inline response is ' || CAST(bytes AS VARCHAR) || ' bytes, exceeding max_bytes limit of 240. Use session=true to store content server-side, or increase max_bytes.' END AS error FROM b""")
def inline_json(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    k = F.col("doc_id")
    score = F.when(k % 4 == 0, 0.5).when(k % 4 == 1, 12345678.25).when(k % 4 == 2, 1e-7).otherwise(2.5e20)
    d = d.select("doc_id", F.when(k % 3 != 0, F.col("lang")).alias("lang"), score.alias("score"), F.array(F.lit(1), F.lit(None).cast("int"), (k % 2 == 0).cast("int")).alias("tags"), F.create_map(F.lit('é"'), F.expr("repeat('é', CAST(doc_id % 40 AS INT))")).alias("note"))
    return sessions.inline(d, 240).select("doc_id", F.col("bytes").cast("int").alias("bytes"), "json", "error_code", "error")
