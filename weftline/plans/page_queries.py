"""Queries of pages, recordings, tools and storage over texts made from customers and events, and their SQL.

The pages are made by one SQL expression that both engines read, so that what is read from them can be told in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import classify, obfuscate, text
from weftline.operators import crawl, html, metrics, recording, retention, sessions
from weftline.operators.ranks import numbered
from weftline.plans.profiles import REQUIRED, with_missing_keys
from weftline.sources import readers
from weftline.storage import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_N = "CAST(c_custkey AS {text})"
_HTML = f"""'<!DOCTYPE html><html lang="' || CASE WHEN c_custkey % 3 = 0 THEN 'de' ELSE 'en' END || '"><head><title>Shop &amp; {'{n}'}</title><meta name="author" content="N{'{n}'}"><meta property="og:type" content="shop"></head><body class="page">'
|| '<header id="top"><h1>Shop {'{n}'}</h1></header><nav class="menu"><a href="/c/{'{n}'}">Cat</a><a href="https://other.example/{'{n}'}" title="out">Out</a><a href="#top">up</a><a href="javascript:void(0)">js</a><a href="/c/{'{n}'}">again</a></nav>'
|| '<main id="content"><article class="post"><h2 id="h{'{n}'}">Item {'{n}'}</h2><p class="lead">First {'{n}'}</p><p>Second</p><ul><li>a</li><li>b{'{n}'}</li><li>c</li></ul>'
|| '<img src="/img/{'{n}'}.png" alt="Pic {'{n}'}"><img src="https://cdn.example/x.png"><img alt="none"></article>' || CASE WHEN c_custkey % 2 = 0 THEN '<div class="ad-slot">Buy {'{n}'}</div>' ELSE '' END
|| '<form id="f" action="/find" method="post"><input type="search" name="q" required><input name="n"><textarea name="t" id="ta"></textarea><select name="s"></select></form></main>'
|| '<aside>' || repeat('word ', CAST(c_custkey % 80 AS INT)) || '</aside><footer><p>End</p></footer></body></html>'"""


def _html(kind: str) -> str:
    return _HTML.replace("{n}", "' || " + _N.replace("{text}", kind) + " || '")


def _shops(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(k, url, html) of a page for each customer. Millions of keys fit in one split of a file; ``spread`` deals them out to
    several tasks for each core before pages are made of them."""
    keys = _table(spark, sf_dir, "customer").select("c_custkey")
    keys = keys.repartition(8 * spark.sparkContext.defaultParallelism, "c_custkey") if spread else keys
    return keys.select(F.col("c_custkey").alias("k"), F.expr("'http://shop' || CAST(c_custkey AS STRING) || '.example/p'").alias("url"), F.expr(_html("STRING")).alias("html"))


_K = "WITH s AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS n FROM customer)"


@_query(f"""{_K} SELECT k, 0 AS pos, 'http://shop' || n || '.example/img/' || n || '.png' AS image, 'Pic ' || n AS alt FROM s UNION ALL SELECT k, 1, 'https://cdn.example/x.png', '' FROM s""")
def page_images(spark, sf_dir):
    d = html.extract(_shops(spark, sf_dir), ("images",)).select("k", F.posexplode("page.images").alias("pos", "i"))
    return d.select("k", "pos", F.col("i.url").alias("image"), "i.alt")


@_query(f"{_K} SELECT k, 'author' AS name, 'N' || n AS content FROM s UNION ALL SELECT k, 'og:type', 'shop' FROM s")
def page_meta(spark, sf_dir):
    return html.extract(_shops(spark, sf_dir), ("meta",)).select("k", F.explode("page.meta").alias("name", "content"))


@_query(f"""{_K} SELECT k, pos, 'f' AS id, '/find' AS action, 'POST' AS method, type, name, field_id, required FROM s,
  (VALUES (0, 'search', 'q', NULL, true), (1, 'text', 'n', NULL, false), (2, 'textarea', 't', 'ta', false), (3, 'select', 's', NULL, false)) f(pos, type, name, field_id, required)""")
def page_forms(spark, sf_dir):
    d = html.structure(_shops(spark, sf_dir), ("forms",)).select("k", F.explode("structure.forms").alias("f")).select("k", "f.*")
    return d.select("k", "id", "action", "method", F.posexplode("fields").alias("pos", "x")).select("k", "pos", F.col("id"), "action", "method", "x.type", "x.name", F.col("x.id").alias("field_id"), "x.required")


@_query(f"""{_K} SELECT k, 0 AS pos, 'http://shop' || n || '.example/c/' || n AS link, 'Cat' AS text, NULL AS title, false AS external FROM s UNION ALL SELECT k, 1, 'https://other.example/' || n, 'Out', 'out', true FROM s""")
def page_links(spark, sf_dir):
    d = html.extract(_shops(spark, sf_dir), ("links",)).select("k", F.posexplode("page.links").alias("pos", "l"))
    return d.select("k", "pos", F.col("l.url").alias("link"), "l.text", "l.title", "l.external")


@_query(f"{_K} SELECT k, 'Shop & ' || n AS title, CASE WHEN k % 3 = 0 THEN 'de' ELSE 'en' END AS language, 'Shop ' || n AS h1, 'Item ' || n AS h2, 'h' || n AS h2_id FROM s")
def page_title_outline(spark, sf_dir):
    d = html.structure(_shops(spark, sf_dir), ("outline",))
    at = lambda i: F.get("structure.outline", F.lit(i))
    return d.select("k", "structure.title", "structure.language", at(0)["text"].alias("h1"), at(1)["text"].alias("h2"), at(1)["id"].alias("h2_id"))


_MAIN = "'Item ' || n || chr(10) || 'First ' || n || chr(10) || 'Second' || chr(10) || 'a' || chr(10) || 'b' || n || chr(10) || 'c'"


@_query(f"{_K} SELECT k, {_MAIN} || CASE WHEN k % 2 = 0 THEN chr(10) || 'Buy ' || n ELSE '' END AS text, {_MAIN} AS without_adverts FROM s")
def page_main_content(spark, sf_dir):
    d = html.extract(_shops(spark, sf_dir), (), main_content=True).select("k", "url", "html", F.col("page.text").alias("text"))
    return html.extract(d, (), main_content=True, filter_noise=True).select("k", "text", F.col("page.text").alias("without_adverts"))


#: Selectors, and in SQL the text or the error of each.
_SELECTORS = {
    "li:nth-child(2)": "'b' || n", "p.lead + p": "'Second'", "h2 ~ p": "'First ' || n || chr(10) || chr(10) || 'Second'", "ul > li:not(:first-child)": "'b' || n || chr(10) || chr(10) || 'c'",
    "[property^='og'], h2[id$=x]": "''", "main p:last-of-type": "'Second'", "article:has(> h2) h2": "'Item ' || n", "section": "'Selector did not match any elements: section'", "li:nope": "'Invalid selector: li:nope'",
    "#content > article.post li:first-child": "'a'", "nav a[href*=other]": "'Out'", "p >": "'Invalid selector: p >'",
}


@_query(_K + " " + " UNION ALL ".join(f"""SELECT k, '{s.replace("'", "''")}' AS selector, {sql} AS said FROM s""" for s, sql in _SELECTORS.items()))
def page_selectors(spark, sf_dir):
    d = html.selected(_shops(spark, sf_dir, spread=True), tuple(_SELECTORS))
    return d.select("k", "found.selector", F.coalesce("found.error", "found.text").alias("said"))


@_query(f"""{_K}, t AS (SELECT k, n, trim(repeat('word ', CAST(k % 80 AS INT))) AS w, 'Item ' || n || ' First ' || n || ' Second a b' || n || ' c' AS post FROM s)
  SELECT k, 'header' AS tag, 'top' AS id, '' AS classes, 'Shop ' || n AS heading, 0 AS links_count, 'Shop ' || n AS text_preview FROM t
  UNION ALL SELECT k, 'nav', NULL, 'menu', NULL, 5, 'Cat Out up js again' FROM t
  UNION ALL SELECT k, 'main', 'content', '', 'Item ' || n, 0, post || CASE WHEN k % 2 = 0 THEN ' Buy ' || n ELSE '' END FROM t
  UNION ALL SELECT k, 'article', NULL, 'post', 'Item ' || n, 0, post FROM t
  UNION ALL SELECT k, 'aside', NULL, '', NULL, 0, CASE WHEN length(w) > 200 THEN w[1:200] || '...' ELSE w END FROM t UNION ALL SELECT k, 'footer', NULL, '', NULL, 0, 'End' FROM t""")
def page_sections(spark, sf_dir):
    d = html.structure(_shops(spark, sf_dir), ("sections",)).select("k", F.explode("structure.sections").alias("s")).select("k", "s.*")
    return d.withColumn("classes", F.array_join("classes", " "))


@_query(f"""{_K} SELECT k, 2 AS navigation, 1 AS internal, 1 AS external FROM s""")
def page_link_sets(spark, sf_dir):
    s = html.structure(_shops(spark, sf_dir), ("navigation", "internal_links", "external_links"))
    return s.select("k", *[F.size(f"structure.{c}").alias(a) for c, a in (("navigation", "navigation"), ("internal_links", "internal"), ("external_links", "external"))])


@_query(f"""{_K} SELECT k AS crawl_id, 0 AS seq, 1 AS depth, 'http://shop' || n || '.example/p' AS url, 'Shop & ' || n AS title, false AS has_links FROM s
  UNION ALL SELECT k, 1, 2, 'http://shop' || n || '.example/c/' || n, 'Second ' || n, false FROM s WHERE k % 4 <> 0""")
def crawl_site(spark, sf_dir):
    shops = _shops(spark, sf_dir)
    n = F.col("k").cast("string")
    second = shops.where("k % 4 <> 0").select(F.regexp_replace("url", "/p$", "/c/").alias("url"), n.alias("n"))
    second = second.select(F.concat("url", "n").alias("url"), F.concat(F.lit("<title>Second "), "n", F.lit("</title><a href='/p'>back</a>")).alias("html"))
    seeds = shops.select(F.col("k").alias("crawl_id"), F.col("url").alias("start_url"))
    d = crawl.crawl_site(seeds, shops.select("url", "html").unionByName(second), depth=2)
    return d.select("crawl_id", "seq", "depth", "url", "page.title", F.lit("links" in d.schema["page"].dataType.names).alias("has_links"))


# ---------------------------------------------------------------- recordings

_FETCH = "WITH f AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS n, CASE c_custkey % 10 WHEN 0 THEN 404 WHEN 1 THEN 302 WHEN 2 THEN 0 ELSE 200 END AS status, c_custkey % 10 = 2 AS broken FROM customer)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = "CAST(c_custkey AS STRING)"
    return _table(spark, sf_dir, "customer").select(
        F.expr(f"'https://Shop-' || {n} || '.example/a/'").alias("url"), F.expr("CASE c_custkey % 10 WHEN 0 THEN 404 WHEN 1 THEN 302 WHEN 2 THEN 0 ELSE 200 END").alias("status_code"),
        F.expr("CASE WHEN c_custkey % 10 = 2 THEN 'reset' END").alias("error"), F.lit("text/html").alias("content_type"), F.expr(f"'<pre>Order ' || {n} || ' is on its way</pre>'").alias("content"),
    )


@_query(f"""{_FETCH} SELECT count(*) AS attempted, count(*) FILTER (status BETWEEN 200 AND 399 AND NOT broken) AS recorded, count(*) FILTER (NOT (status BETWEEN 200 AND 399 AND NOT broken)) AS failed,
  CAST(sum(CASE WHEN status BETWEEN 200 AND 399 AND NOT broken THEN length('<pre>Order ' || n || ' is on its way</pre>') END) AS BIGINT) AS bytes FROM f""")
def record_totals(spark, sf_dir):
    return recording.totals(recording.record(_results(spark, sf_dir)))


@_query(f"""{_FETCH} SELECT 1 AS version, '2026-01-01' AS recorded_at, 'shop_' || n || '_example_a' AS slug, 'https://Shop-' || n || '.example/a/' AS original_url, 'shop_' || n || '_example_a/index.html' AS path,
  'text/html' AS content_type, status AS original_status, CAST(length('<pre>Order ' || n || ' is on its way</pre>') AS BIGINT) AS size_bytes, true AS obfuscated FROM f WHERE status BETWEEN 200 AND 399 AND NOT broken""")
def record_manifest(spark, sf_dir):
    return readers.manifest_files(recording.site_manifests(recording.record(_results(spark, sf_dir)), "2026-01-01"))


# Words of replacement texts, repeated so that the SQL doesn't use the code that it tests.
_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
)


@_query(f"""{_K}, w AS (SELECT string_split('{_WORDS}', ' ') AS w),
t AS (SELECT k, 'Text ' || n || repeat(' of it', CAST(k % 30 AS INT)) AS t FROM s),
a AS (SELECT k, t, w, CAST(('0x' || md5(t)[1:8]) AS BIGINT) % len(w) AS first FROM t, w),
b AS (SELECT k, t, list_concat(list_concat(w[first + 1:], w[1:first]), w) AS w FROM a),
c AS (SELECT *, list_transform(range(1, 60), lambda i: array_to_string(w[1:i], ' ')) AS upto FROM b),
d AS (SELECT *, list_filter(range(1, 60), lambda i: coalesce(length(upto[i - 1]), 0) < length(t) AND length(upto[i]) <= length(t) + 5) AS good FROM c),
e AS (SELECT *, coalesce(list_filter(range(1, 60), lambda i: NOT list_contains(good, i))[1] - 1, 0) AS words FROM d),
f AS (SELECT k, t, coalesce(upto[words], '') AS x FROM e)
SELECT k, CASE WHEN length(x) > length(t) THEN rtrim(x[1:length(t)]) ELSE rpad(x, CAST(length(t) AS INT), ' ') END AS said FROM f""")
def text_lorem(spark, sf_dir):
    t = F.concat(F.lit("Text "), F.col("c_custkey").cast("string"), F.expr("repeat(' of it', CAST(c_custkey % 30 AS INT))"))
    d = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), obfuscate.scrub_text(F.concat(F.lit("<pre><code>kept</pre><p>"), t, F.lit("</p>"))).alias("page"))
    return d.select("k", F.regexp_extract("page", r"^<pre><code>kept</pre><p>(.*)</p>$", 1).alias("said"))


@_query(f"""{_K} SELECT k, 'Call +0 (000) 000-0000 or 000.000.0000 now, not 555-0101, mail ' || repeat('x', CAST(length('a.b' || n || '@shop.example') AS INT)) || ' <img src="data"> room 12' AS said FROM s""")
def pii_phones(spark, sf_dir):
    n, four = "CAST(c_custkey AS STRING)", "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
    said = F.expr(f"""'Call +1 (312) 555-' || {four} || ' or 212.555.' || {four} || ' now, not 555-0101, mail a.b' || {n} || '@shop.example <img src="data"> room 12'""")
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), obfuscate.scrub_pii(said).alias("said"))


@_query(f"{_K} SELECT k, 2 AS placeholders, false AS has_source FROM s")
def media_scrub(spark, sf_dir):
    d = _shops(spark, sf_dir).select("k", obfuscate.scrub_media(F.col("html")).alias("page"))
    return d.select("k", F.regexp_count("page", F.lit("data:image/svg")).alias("placeholders"), (F.col("page").contains("/img/") | F.col("page").contains("cdn.example")).alias("has_source"))


def _own_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query(ORACLES["record_manifest"])
def record_roundtrip(spark, sf_dir):
    """What is recorded, written and read again."""
    path = _own_dir(spark, "recording")
    recording.write(recording.record(_results(spark, sf_dir)), "2026-01-01", path)
    return readers.manifest_files(spark.read.schema(readers.MANIFEST).json(f"{path}/manifest"))


@_query(f"""{_FETCH} SELECT 'shop_' || n || '_example_a' AS slug, '<pre>Order ' || n || ' is on its way</pre>' AS html FROM f WHERE status BETWEEN 200 AND 399 AND NOT broken""")
def record_pages(spark, sf_dir):
    path = _own_dir(spark, "recorded-pages")
    readers.write_pages(recording.record(_results(spark, sf_dir)).where("success"), path)
    return readers.recorded_pages(spark, path)


@_query(f"""{_K} SELECT k, CAST(row_number() OVER (ORDER BY 'http://base/' || 'site' || n || '/index.html') AS INTEGER) AS place, 'http://base/site' || n || '/index.html' AS url FROM s""")
def fixture_urls(spark, sf_dir):
    files = _table(spark, sf_dir, "customer").select(F.concat(F.lit("file:/data/fixtures/site"), F.col("c_custkey").cast("string"), F.lit("/index.html")).alias("path"))
    urls = readers.fixture_urls(files, "fixtures", "http://base/")
    placed = numbered(urls, ["url"], "place")
    return placed.select(F.regexp_extract("url", r"site(\d+)/", 1).cast("long").alias("k"), F.col("place").cast("int").alias("place"), "url")


@_query("""SELECT '{"config":{"mode":"load","consumers":' || CAST(count(*) AS VARCHAR) || '},"result":{"ok":' || CAST(count(*) FILTER (event_type <> 'error') AS VARCHAR) || ',"error":' || CAST(count(*) FILTER (event_type = 'error') AS VARCHAR) || '}}' AS report FROM events""")
def simulation_report(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    config = e.agg(F.lit("load").alias("mode"), F.count("*").alias("consumers"))
    return recording.simulation_report(config, e.agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("error")))


# ---------------------------------------------------------------- texts

@_query("""WITH t AS (SELECT doc_id, text AS t, substr(text, 1, 300) AS c FROM documents),
  p AS (SELECT *, CASE WHEN contains(c, '. ') THEN 299 - strpos(reverse(c), ' .') ELSE -1 END AS dot, CASE WHEN contains(c, chr(10)) THEN 300 - strpos(reverse(c), chr(10)) ELSE -1 END AS line FROM t),
  q AS (SELECT *, CASE WHEN greatest(dot, line) > 240 THEN substr(t, 1, CAST(greatest(dot, line) + 1 AS BIGINT)) ELSE c END AS cut FROM p)
  SELECT doc_id, md5(CASE WHEN length(t) > 300 THEN rtrim(cut, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) || chr(10) || '[Content truncated]' ELSE t END) AS digest FROM q""")
def text_truncate(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.truncated(F.col("text"), F.lit(300)).cast("binary")).alias("digest"))


@_query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace('  a' || chr(9) || ' b' || repeat(chr(10), CAST(doc_id % 6 AS INT)) || source || '   x ' || chr(10), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents""")
def text_clean_space(spark, sf_dir):
    t = F.expr("'  a' || char(9) || ' b' || repeat(char(10), CAST(doc_id % 6 AS INT)) || source || '   x ' || char(10)")
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_space(t).cast("binary")).alias("digest"))


@_query("""WITH r AS (SELECT unnest(['name', 'display_name', 'timezone', 'utc_offset', 'date_patterns', 'section_labels', 'noise_markers', 'sponsored_markers', 'exclusive_markers', 'opinion_labels']) AS key, unnest(range(0, 10)) AS i)
  SELECT s_suppkey, string_agg(key, ',' ORDER BY i) AS missing FROM supplier, r WHERE s_suppkey % 11 = 10 OR (s_suppkey + i) % 3 = 0 GROUP BY s_suppkey""")
def profile_missing(spark, sf_dir):
    """A profile for each supplier, without every third key, or no object at all."""
    has = lambda i, key: F.when((F.col("s_suppkey") + i) % 3 != 0, F.lit(f'"{key}": []'))
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *[has(i, key) for i, key in enumerate(REQUIRED)], F.lit('"more": 1')), F.lit("}"))
    d = _table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 11 != 10, whole).otherwise("[1]").alias("value"))
    return with_missing_keys(d).where(F.size("missing") > 0).select("s_suppkey", F.array_join("missing", ",").alias("missing"))


# ---------------------------------------------------------------- classifiers and tools


@_query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'auth_error' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'network_timeout' WHEN 3 THEN 'network_error' WHEN 4 THEN 'mcp_tool_failed' WHEN 5 THEN 'auth_error' ELSE 'rate_limited' END AS error_type FROM events""")
def tool_errors(spark, sf_dir):
    payload = F.expr("""CASE event_id % 7 WHEN 0 THEN '{"error_code": "TOKEN_EXPIRED"}' WHEN 1 THEN '{"error_code": "", "error": "HTTP 429"}' WHEN 2 THEN '{"error": "Timeout!"}' WHEN 3 THEN '{"error_code": "FETCH_ERROR", "error": "timeout"}'
      WHEN 4 THEN '{"success": false}' WHEN 5 THEN '{"error": "unauthorized by rate"}' ELSE '{"error": "we throttle"}' END""")
    return _table(spark, sf_dir, "events").select("event_id", classify.tool_error_type(payload).alias("error_type"))


@_query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'network_timeout' WHEN 1 THEN 'network_connect' WHEN 2 THEN 'network_protocol' WHEN 3 THEN 'network_error' WHEN 4 THEN 'ValueError' WHEN 5 THEN 'network_timeout' ELSE 'network_error' END AS error_type,
  CASE event_id % 4 WHEN 0 THEN 'SELECTOR_NOT_FOUND' WHEN 1 THEN 'INVALID_SELECTOR' WHEN 2 THEN 'ENCODING_ERROR' ELSE 'EXTRACTION_ERROR' END AS extraction_code,
  CASE event_id % 3 WHEN 0 THEN 'SESSION_NOT_FOUND' WHEN 1 THEN 'TIMEOUT' ELSE 'G_U_I_D' END AS class_code FROM events""")
def exception_classes(spark, sf_dir):
    name = F.expr("CASE event_id % 7 WHEN 0 THEN 'ReadTimeout' WHEN 1 THEN 'ConnectError' WHEN 2 THEN 'RemoteProtocolError' WHEN 3 THEN 'ProxyError' WHEN 4 THEN 'ValueError' WHEN 5 THEN 'PoolTimeout' ELSE 'TooManyRedirects' END")
    said = F.expr("CASE event_id % 4 WHEN 0 THEN 'The Selector did not match' WHEN 1 THEN 'Invalid selector: x' WHEN 2 THEN 'cannot decode byte' ELSE 'other' END")
    kind = F.expr("CASE event_id % 3 WHEN 0 THEN 'SessionNotFoundError' WHEN 1 THEN 'TimeoutError' ELSE 'GUIDError' END")
    return _table(spark, sf_dir, "events").select("event_id", classify.exception_type(name).alias("error_type"), classify.extraction_error_code(said).alias("extraction_code"), classify.error_code_of_class(kind).alias("class_code"))


@_query("""SELECT event_id, least(CASE event_id % 5 WHEN 0 THEN 7.0::DOUBLE WHEN 1 THEN 90.0::DOUBLE ELSE pow(2.0::DOUBLE, event_id % 7) + (event_id % 100) / 100.0::DOUBLE END, 30.0::DOUBLE) AS seconds,
  event_id % 4 IN (1, 2) AS caller_retries FROM events""")
def fetch_delay(spark, sf_dir):
    after = F.expr("CASE event_id % 5 WHEN 0 THEN '7' WHEN 1 THEN ' 90 ' WHEN 2 THEN 'Wed, 21 Oct' WHEN 3 THEN '1.5' END")
    status = F.expr("CAST(CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 404 END AS INT)")
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", classify.fetch_delay_seconds(F.col("event_id") % 7, after, (F.col("event_id") % 100) / 100.0).alias("seconds"), classify.retryable(status, fetcher=False).alias("caller_retries"))


# Codes and texts, repeated so that the SQL doesn't use the code that it tests.
@_query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY error_code) - 1 AS i, count(*) OVER () AS n FROM (VALUES
('INVALID_URL', 'Ensure the URL is properly formatted with http:// or https:// scheme.'), ('URL_NOT_FOUND', 'Verify the URL exists and is accessible. The server returned 404.'),
('FETCH_ERROR', 'Check network connectivity and that the target site is online. Try again later.'), ('TIMEOUT_ERROR', 'The request timed out. Try increasing timeout or check if the site is slow/unresponsive.'),
('CONNECTION_ERROR', 'Could not connect to the server. Verify the URL and check network connectivity.'), ('ROBOTS_BLOCKED', 'Access blocked by robots.txt. Choose a URL/path that is allowed by the target site''s robots policy.'),
('ACCESS_DENIED', 'The server denied access. Try using a different anti-detection profile or custom headers.'), ('RATE_LIMITED', 'Too many requests. Increase rate_limit_delay in set_antidetection settings.'),
('RATE_LIMIT_EXCEEDED', 'Inbound rate limit exceeded. Wait and retry after the reset window.'), ('SSRF_BLOCKED', 'The URL resolves to a private/internal IP. Requests to internal networks are blocked for security.'),
('SELECTOR_NOT_FOUND', 'The CSS selector matched no elements. Verify the selector syntax and that the element exists on the page.'), ('INVALID_SELECTOR', 'The CSS selector syntax is invalid. Check for typos and proper CSS selector format.'),
('EXTRACTION_ERROR', 'Failed to extract content. The page may have unexpected structure or encoding.'), ('ENCODING_ERROR', 'Character encoding issue. The page may use an unsupported encoding.'),
('INVALID_PROFILE', 'Use one of: ''stealth'', ''balanced'', ''none'', or ''custom'' for anti-detection profile.'), ('INVALID_HEADERS', 'Custom headers must be a dictionary with string keys and values.'),
('INVALID_RATE_LIMIT', 'rate_limit_delay must be a non-negative number (seconds between requests).'), ('MAX_DEPTH_EXCEEDED', 'Crawl depth is limited to 3. Use depth=1, 2, or 3.'),
('MAX_PAGES_EXCEEDED', 'Too many pages requested. Reduce max_pages_per_level (max 20).'),
('UNKNOWN_TOOL', 'Available tools: ping, set_antidetection, get_content, get_structure, get_session_info, get_session_chunk, list_sessions, get_session_urls, get_session.'),
('INVALID_ARGUMENT', 'A required argument is missing or invalid. Check the tool schema for required parameters.'), ('INVALID_MAX_RESPONSE_CHARS', 'max_response_chars must be between 4000 and 4000000. Default is 400000 characters.'),
('AUTH_ERROR', 'Provide a valid JWT token in the auth_token parameter.'), ('PERMISSION_DENIED', 'Your token''s groups do not include the group that owns this session.'),
('SESSION_ERROR', 'Session operation failed. Use list_sessions to check available sessions.'), ('SESSION_NOT_FOUND', 'Session ID not found. Use list_sessions to discover sessions, or create one with get_content(session=true).'),
('INVALID_CHUNK_INDEX', 'Chunk index out of range. Use get_session_info to check the total number of chunks.'),
('PARSE_ERROR', 'The news parser failed to process the crawl results. Retry with parse_results=false to get raw output, or check source_profile_name for the target site.'),
('CONFIGURATION_ERROR', 'Check server configuration. Contact administrator if issue persists.'), ('OTHER', 'Review the error message and try again. Contact support if the issue persists.')) t(error_code, recovery_strategy))
SELECT error_code, recovery_strategy, count(*) AS n FROM r JOIN events ON event_id % r.n = r.i GROUP BY ALL""")
def recovery_texts(spark, sf_dir):
    """Every event as one of the errors, in turn."""
    codes = F.array(*map(F.lit, sorted([*classify.RECOVERY, "OTHER"])))
    d = _table(spark, sf_dir, "events").select(F.get(codes, (F.col("event_id") % F.size(codes)).cast("int")).alias("error_code"))
    return classify.with_recovery(d, classify.recovery_table(spark)).groupBy("error_code", "recovery_strategy").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- simulation


@_query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'aaa.bbb' WHEN 1 THEN 'invalid.invalid.invalid' WHEN 2 THEN 'literal' END AS token FROM customer""")
def token_map(spark, sf_dir):
    token = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'token_us' WHEN 1 THEN 'token_invalid' WHEN 2 THEN 'literal' END")
    names = spark.createDataFrame([("token_us", "aaa.bbb"), ("token_invalid", "invalid.invalid.invalid")], "name string, value string")
    return classify.with_tokens(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), token.alias("token")), names).select("k", "token")


@_query("""WITH u AS (SELECT 'http://n/' || n_name AS url, row_number() OVER (ORDER BY 'http://n/' || n_name) - 1 AS place, count(*) OVER () AS size FROM nation)
  SELECT event_id, url, 'http://one/' AS fixed FROM events JOIN u ON event_id % size = place""")
def url_round_robin(spark, sf_dir):
    urls = _table(spark, sf_dir, "nation").select(F.concat(F.lit("http://n/"), "n_name").alias("url"))
    turns = readers.round_robin(urls, _table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("n")))
    fixed = readers.one_url(turns.withColumnRenamed("url", "taken"), "http://one/")
    return fixed.select("event_id", F.col("taken").alias("url"), F.col("url").alias("fixed"))


@_query("SELECT 500 AS chosen, 500 AS distinct_events, 0 AS strangers FROM (SELECT 1)")
def url_choice(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id")
    chosen = readers.choose_urls(e, 500, seed=3)
    known = chosen.join(e.withColumn("known", F.lit(1)), "event_id", "left")
    return known.agg(F.count("*").cast("int").alias("chosen"), F.countDistinct("event_id").cast("int").alias("distinct_events"), F.count_if(F.col("known").isNull()).cast("int").alias("strangers"))


@_query("SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 300)")
def request_budget(spark, sf_dir):
    return readers.within_budget(_table(spark, sf_dir, "events"), 300, ["ts", "event_id"]).select("event_id")


@_query("SELECT count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS error FROM events")
def call_counters(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return metrics.counters(e.select(F.col("event_type").alias("tool_name"), F.lit("p").alias("persona"), F.lit(1).alias("duration_ms"), (F.col("event_type") != "error").alias("success"), F.lit(None).cast("string").alias("error_type")))


@_query("""SELECT event_type AS tool_name, least(count(*), 100) AS kept, least(count(*), 100) AS distinct_kept, 0 AS strangers FROM events GROUP BY event_type""")
def call_sample(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool_name"))
    kept = metrics.sampled(e, 100, seed=5, by=["tool_name"]).join(e.withColumn("known", F.lit(1)), ["event_id", "tool_name"], "left")
    return kept.groupBy("tool_name").agg(F.count("*").alias("kept"), F.countDistinct("event_id").alias("distinct_kept"), F.count_if(F.col("known").isNull()).cast("int").alias("strangers"))


@_query("""SELECT user_id, greatest(CAST(max(event_id) - 500 AS DOUBLE), 0.0::DOUBLE) AS duration, CASE WHEN max(event_id) > 500 THEN count(*) / CAST(max(event_id) - 500 AS DOUBLE) ELSE 0.0::DOUBLE END AS rps FROM events GROUP BY user_id""")
def throughput(spark, sf_dir):
    runs = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.lit(500.0).alias("started"), F.max("event_id").cast("double").alias("ended"), F.count("*").alias("requests"))
    return metrics.throughput(runs).select("user_id", "duration", "rps")


# ---------------------------------------------------------------- storage and sessions

_ITEMS = """item AS (SELECT 'g' || CAST(doc_id AS VARCHAR) AS guid, '2026-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS created_at, CAST(strlen(text) AS BIGINT) AS size,
  CASE WHEN doc_id % 5 <> 0 THEN lang END AS grp, doc_id % 11 <> 0 AS has_metadata, source AS scope FROM documents)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("guid"), F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("created_at"),
        F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("grp"), (F.col("doc_id") % 11 != 0).alias("has_metadata"), F.col("source").alias("scope"),
    )


@_query(f"""WITH {_ITEMS}, r AS (SELECT *, has_metadata AND sum(size) OVER (PARTITION BY scope) - coalesce(sum(CASE WHEN has_metadata THEN size ELSE 0 END) OVER (PARTITION BY scope ORDER BY created_at, has_metadata, guid, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 50000 AS gone FROM item),
  t AS (SELECT scope, CAST(sum(size) AS BIGINT) AS bytes_before, CAST(coalesce(sum(size) FILTER (NOT gone), 0) AS BIGINT) AS bytes_after, count(*) FILTER (gone) AS deleted, count(*) FILTER (NOT has_metadata) AS orphans,
  CAST(coalesce(sum(size) FILTER (NOT has_metadata), 0) AS BIGINT) AS orphan_bytes FROM r GROUP BY scope) SELECT *, CASE WHEN bytes_after > 50000 THEN 1 ELSE 0 END AS exit_code FROM t""")
def retention_summary(spark, sf_dir):
    return retention.prune_summary(retention.prune_plan(_items(spark, sf_dir), 50000), 50000)


@_query(f"""WITH {_ITEMS} SELECT guid, 'age' AS kind FROM item WHERE NOT (CAST(created_at AS DATE) < DATE '2026-01-11')
  UNION ALL SELECT guid, 'group' FROM item WHERE NOT (CAST(created_at AS DATE) < DATE '2026-01-11' AND coalesce(grp, '') = 'en') UNION ALL SELECT guid, 'all of a group' FROM item WHERE coalesce(grp, '') <> 'de'""")
def retention_purge(spark, sf_dir):
    d = _items(spark, sf_dir)
    parts = {"age": retention.purge(d, "2026-01-21", 10), "group": retention.purge(d, "2026-01-21", 10, "en"), "all of a group": retention.purge(d, "2026-01-21", 0, "de")}
    out = None
    for kind, rows in parts.items():
        rows = rows.select("guid", F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(f"WITH {_ITEMS} SELECT guid, size FROM item WHERE NOT has_metadata")
def storage_orphans(spark, sf_dir):
    d = _items(spark, sf_dir)
    return retention.orphans(d.select("guid", "size"), d.where("has_metadata").select("guid"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return sessions.stored(
        d.select(
            F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"),
            F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("grp"), F.lit("2026-01-01").alias("created_at"), F.col("text").alias("content"),
        ), 400,
    )


@_query("""SELECT 's' || CAST(doc_id AS VARCHAR) AS session_id, 'http://x/' || CAST(doc_id AS VARCHAR) AS url, 400 AS chunk_size, CAST(greatest(ceil(length(text) / 400.0), 1) AS INTEGER) AS total_chunks, CAST(length(text) AS INTEGER) AS total_chars, md5(text) AS digest FROM documents""")
def session_write(spark, sf_dir):
    """Sessions written and read again."""
    path, d = _own_dir(spark, "sessions"), _table(spark, sf_dir, "documents")
    rows = d.select(F.expr("'s' || CAST(doc_id AS STRING)").alias("session_id"), F.expr("'http://x/' || CAST(doc_id AS STRING)").alias("url"), F.col("source").alias("grp"), F.lit("2026-01-01").alias("created_at"), F.col("text").alias("content"))
    sessions.write(rows, path, 400)
    return spark.read.parquet(path).select("session_id", "url", "chunk_size", "total_chunks", "total_chars", F.md5(F.col("content").cast("binary")).alias("digest"))


@_query("""SELECT 's' || CAST(doc_id AS VARCHAR) AS session_id, CASE WHEN strlen(text) <= 2000 THEN md5(text) END AS digest, CASE WHEN strlen(text) > 2000 THEN 'CONTENT_TOO_LARGE' END AS error_code FROM documents""")
def session_whole(spark, sf_dir):
    return sessions.whole(_sessions(spark, sf_dir), 2000).select("session_id", F.md5(F.col("content").cast("binary")).alias("digest"), "error_code")


@_query("""WITH s AS (SELECT doc_id, text, greatest(ceil(length(text) / 400.0), 1) AS total FROM documents), w AS (SELECT *, unnest([0, 1, 3, -1]) AS i FROM s)
  SELECT 's' || CAST(doc_id AS VARCHAR) AS session_id, i AS chunk_index, CASE WHEN i BETWEEN 0 AND total - 1 THEN md5(substr(text, CAST(i * 400 + 1 AS BIGINT), 400)) END AS digest,
  CASE WHEN NOT i BETWEEN 0 AND total - 1 THEN 'INVALID_CHUNK_INDEX' END AS error_code FROM w""")
def session_chunk(spark, sf_dir):
    d = _sessions(spark, sf_dir)
    wanted = d.select("session_id", F.explode(F.array(*map(F.lit, (0, 1, 3, -1)))).alias("chunk_index"))
    return sessions.chunk(d, wanted).select("session_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("digest"), "error_code")


@_query("""WITH j AS (SELECT doc_id, '{"doc_id": ' || CAST(doc_id AS VARCHAR) || ', "lang": ' || coalesce('"' || lang || '"', 'null') || ', "note": "' || repeat('é', CAST(doc_id % 40 AS INT)) || '"}' AS json FROM documents)
  SELECT doc_id, CAST(length(json) + 5 * (doc_id % 40) AS INT) AS bytes, CASE WHEN length(json) + 5 * (doc_id % 40) <= 150 THEN json END AS json FROM j""")
def inline_cap(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr("repeat('é', CAST(doc_id % 40 AS INT))").alias("note"))
    return sessions.inline(d, 150).select("doc_id", F.col("bytes").cast("int").alias("bytes"), "json")


# ---------------------------------------------------------------- stored responses


@_query("""SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'Zürich €' WHEN 1 THEN 'Zürich' WHEN 2 THEN 'Zürich' WHEN 3 THEN 'Zürich' WHEN 4 THEN 'Z' || chr(65533) || 'rich' END AS content FROM customer""")
def response_charset(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"),
        F.expr("CASE c_custkey % 6 WHEN 0 THEN 'text/html; charset=UTF-8' WHEN 1 THEN 'text/html; charset=\"iso-8859-1\"' WHEN 2 THEN 'text/html; charset=utf-16le' WHEN 3 THEN NULL WHEN 4 THEN 'text/html; charset=nope' END").alias("content_type"),
        F.expr("CASE c_custkey % 6 WHEN 0 THEN unhex('5AC3BC7269636820E282AC') WHEN 1 THEN unhex('5AFC72696368') WHEN 2 THEN unhex('5A00FC00720069006300680000') WHEN 3 THEN unhex('5AC3BC72696368') WHEN 4 THEN unhex('5AFC72696368') END").alias("body"),
    )
    cut = d.withColumn("body", F.when(F.col("k") % 6 == 2, F.substring("body", 1, 12)).otherwise(F.col("body")))
    return readers.decoded(cut).select("k", "content")


@_query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '/end' WHEN 1 THEN '/end' WHEN 2 THEN '/gone' ELSE '/loop' END AS final_url, CASE c_custkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 200 END AS status_code,
  CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 4 END AS hops FROM customer""")
def response_redirects(spark, sf_dir):
    stored = spark.createDataFrame([("/end", 200, "/ignored"), ("/one", 301, "/two"), ("/two", 302, "/end"), ("/away", 308, "/gone"), ("/loop", 307, "/loop")], "url string, status_code int, location string")
    d = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("CASE c_custkey % 4 WHEN 0 THEN '/end' WHEN 1 THEN '/one' WHEN 2 THEN '/away' ELSE '/loop' END").alias("url"))
    return readers.redirected(d, stored, most=3).select("k", "final_url", "status_code", "hops")
