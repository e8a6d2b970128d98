"""Queries of the news feed over pages made from orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.feed import Feed, crawl_utc, with_crawl_time
from weftline.plans.profiles import PROFILES, profiles

#: Pages of a crawl for each customer, one for each order, with those before it: shared by both engines but for the date
#: format.
_PAGES = """
WITH o AS (
  SELECT o_custkey AS k, o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, {date} AS day,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
  FROM orders),
s AS (
  SELECT k, rn,
    CASE k % 4 WHEN 0 THEN 'Companies' WHEN 1 THEN 'Opinion' WHEN 2 THEN 'Markets' ELSE '' END || {nl} ||
    CASE WHEN k % 7 = 0 THEN 'Exclusive' ELSE '' END || {nl} || CASE WHEN k % 11 = 0 THEN 'Paid Post:' ELSE '' END || {nl} ||
    CASE WHEN k % 2 = 0 THEN 'Order ' ELSE 'Tech | Order ' END || CAST(o_orderkey AS {text}) || CASE WHEN k % 9 = 0 THEN ' explainer' ELSE ' placed' END || {nl} ||
    CASE WHEN k % 8 = 0 THEN 'Jane Doe' ELSE o_orderpriority END || {nl} || CASE WHEN k % 6 = 0 THEN '12:34' ELSE '' END || {nl} ||
    CASE WHEN k % 5 = 0 THEN CAST(1 + o_orderkey % 9 AS {text}) || ' hours ago' WHEN k % 13 = 0 THEN 'February 13, 2026' ELSE day || ' - 10:15PM' END || {nl} ||
    'Status ' || o_orderstatus || ' of the order' || {nl} || 'Sentry-Trace id' || {nl} || CASE WHEN k % 3 = 0 THEN CAST(o_orderkey % 100 AS {text}) ELSE 'end' END AS t
  FROM o),
l AS (SELECT *, lag(t, 1) OVER (PARTITION BY k ORDER BY rn) AS t1, lag(t, 2) OVER (PARTITION BY k ORDER BY rn) AS t2 FROM s),
p AS (
  SELECT k, rn AS page_seq, CASE WHEN rn = 1 THEN 1 WHEN rn % 2 = 0 THEN 2 WHEN k % 3 = 0 THEN 1 ELSE 3 END AS depth,
    CASE WHEN rn = 1 THEN t WHEN rn % 2 = 0 THEN 'MOST POPULAR' || {nl} || t1 || {nl} || t ELSE 'Photo: someone' || {nl} || t || {nl} || t2 END AS text FROM l)
SELECT CAST(k AS BIGINT) AS crawl_id, CAST(page_seq AS INT) AS page_seq, 'http://news.example/' || CAST(k AS {text}) || '/' || CAST(page_seq AS {text}) AS url, CAST(depth AS INT) AS depth, text,
  CASE WHEN k % 4 = 0 THEN 'en' END AS language, 'http://news.example/' || CAST(k AS {text}) AS start_url,
  CASE WHEN k % 3 = 0 THEN 'scmp' WHEN k % 3 = 1 THEN 'nobody' END AS source_profile_name
FROM p
"""

_CRAWLED = "2026-02-14T10:30:00Z"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")
    # The exchange that the windows need anyway, in as many parts as there are cores: pages are short and their lines dear, and
    # by their bytes alone they would be put together in a few tasks.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    orders = orders.repartition(parts, "o_custkey")
    sql = _PAGES.format(date="date_format(o_orderdate, 'dd MMM yyyy')", nl="char(10)", text="STRING")
    pages = spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=orders)
    return pages.withColumns({"crawl_time_utc": F.lit(_CRAWLED), "parser_version": F.when(F.col("crawl_id") % 2 == 0, "2"), "meta": F.lit(None).cast("map<string,string>")})


def feed(spark: SparkSession, sf_dir: str) -> Feed:
    return Feed(_pages(spark, sf_dir), profiles(spark))


def feed_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.array_join(F.transform("seen_on_pages", lambda x: x["page_url"]), ",")
    return feed(spark, sf_dir).ordered().select(
        "crawl_id", "position", "story_id", "headline", "subheadline", "section", "published", "published_raw", "body_snippet", F.col("comment_count").cast("string").alias("comment_count"),
        F.array_join("tags", ",").alias("tags"), "content_type", "author", F.col("url").alias("page_url"), "depth", seen.alias("seen_on"), "language",
        "parse_confidence", F.array_join("missing_fields", ",").alias("missing"), "segmentation_reason",
    )


def feed_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).meta()


#: Crawl times as text: with offsets of all kinds, without, as a date; %d is a number of hours.
_TIMES = ("2026-02-14T%d:30:00Z", "2026-02-14 %d:30:05.25+08:00", "2026-02-14T%d:30-0330", "2026-02-14T%d:05:00,5", "2026-02-14")


def feed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in _TIMES]), (F.col("c_custkey") % 5 + 1).cast("int"))
    hour = F.lpad((F.col("c_custkey") % 24).cast("string"), 2, "0")
    d = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.replace(raw, F.lit("%d"), hour).alias("crawl_time_utc"))
    return with_crawl_time(d).select("c_custkey", F.col("crawl_zone").alias("zone"), crawl_utc(F.col("crawl_local"), F.col("crawl_zone")).alias("utc"))


def feed_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).warnings().select("crawl_id", F.col("at.page_seq").alias("page_seq"), F.col("at.kind").alias("kind"), F.col("at.i").alias("i"), "code", "example")


def feed_noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).cleaned.select("crawl_id", "page_seq", F.array_join("kept", "|").alias("kept"), "noise", F.size("rescued").alias("rescued"))


def feed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).segments.select("crawl_id", "page_seq", "ordinal", "anchor", F.array_join("block", "|").alias("block"))


def feed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).unique.select("crawl_id", "story_id", "depth", "duplicates", F.array_join(F.transform("seen_on_pages", lambda x: x["page_url"]), ",").alias("seen_on"))


def feed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).stories.groupBy("content_type", "segmentation_reason", "parse_confidence").agg(F.count("*").alias("stories"))


QUERIES = {f.__name__: f for f in (feed_stories, feed_meta, feed_times, feed_warnings, feed_noise_strip, feed_segments, feed_dedupe, feed_quality)}


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def _stages() -> str:
    rows = ", ".join(
        f"('{p[0]}', '{p[1]}', '{p[3]}', '(?i)' || '{'|'.join(f'(?:{x})' for x in p[4])}', {_sql_list(p[5])}, {_sql_list(p[6])}, {_sql_list(p[7])}, {_sql_list(p[8])}, {_sql_list(p[9])})"
        for p in PROFILES
    )
    pages = _PAGES.format(date="strftime(o_orderdate, '%d %b %Y')", nl="chr(10)", text="VARCHAR")
    return f"""
WITH page AS ({pages}),
prof(name, display_name, zone, pat, labels, noisy, spons, excl, opin) AS (VALUES {rows}),
f0 AS (SELECT page.*, prof.*, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS ln
  FROM page JOIN prof ON prof.name = CASE WHEN source_profile_name = 'scmp' THEN 'scmp' ELSE 'generic' END),
f1 AS (SELECT *, list_transform(ln, lambda x: regexp_matches(x, pat)) AS isd, list_transform(ln, lambda x: x <> '' AND (list_contains(noisy, x) OR starts_with(x, 'Photo:')
  OR starts_with(x, 'Illustration:') OR regexp_matches(x, '^[0-9]{{2}}:[0-9]{{2}}$') OR contains(lower(x), 'sentry-trace') OR contains(lower(x), 'baggage') OR contains(lower(x), 'appstore'))) AS isn FROM f0),
f2 AS (SELECT *, list_transform(ln, lambda x, i: {{'line': x, 'state': CASE WHEN NOT isn[i] THEN 0 WHEN coalesce(isd[i - 1], false) OR coalesce(isd[i + 1], false) THEN 1 ELSE 2 END}}) AS st FROM f1),
clean AS (SELECT * EXCLUDE (ln, isd, isn), list_transform(list_filter(st, lambda s: s.state < 2 AND s.line <> ''), lambda s: s.line) AS kept,
  CAST(len(list_filter(st, lambda s: s.state = 2)) AS INTEGER) AS noise, list_transform(list_filter(st, lambda s: s.state = 1), lambda s: s.line[1:120]) AS rescued FROM f2),
a0 AS (SELECT *, list_filter(range(1, len(kept) + 1), lambda i: regexp_matches(kept[i], pat)) AS anchors FROM clean),
a1 AS (SELECT *, unnest(range(1, len(anchors) + 1)) AS ord FROM a0 WHERE len(anchors) > 0),
seg AS (SELECT *, kept[coalesce(anchors[ord - 1] + 1, 1):coalesce(anchors[ord + 1] - 1, len(kept))] AS block, anchors[ord] - coalesce(anchors[ord - 1] + 1, 1) + 1 AS anc FROM a1),
s0 AS (SELECT *, block[anc] AS published_raw, block[1:anc - 1] AS above, block[anc + 1:] AS post FROM seg),
s1 AS (SELECT *, list_filter(above, lambda x: NOT list_contains(excl, x) AND NOT list_contains(spons, x)) AS pre FROM s0),
s2 AS (SELECT *, coalesce(nullif(list_position(list_transform(pre, lambda x: list_contains(labels, x)), false), 0) - 1, len(pre)) AS run FROM s1),
s3 AS (SELECT *, CASE WHEN run > 0 THEN pre[run] END AS sec1, pre[run + 1:] AS rem FROM s2),
s4 AS (SELECT *, coalesce(list_position(list_transform(rem, lambda x: contains(x, '|')), true), 0) AS pipe FROM s3),
s5 AS (SELECT *, coalesce(sec1, CASE WHEN pipe > 1 AND list_contains(opin, rem[pipe - 1]) THEN rem[pipe - 1] END) AS sec2, rem[greatest(pipe, 1)] AS h1, rem[greatest(pipe, 1) + 1] AS nx FROM s4),
s6 AS (SELECT *, CASE WHEN NOT list_contains(opin, nx) AND NOT regexp_full_match(nx, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{1,2}}') THEN nx END AS subheadline,
  CASE WHEN h1 IS NULL THEN 'date_anchor+nearest_preceding_line_fallback' ELSE 'date_anchor+heading_alignment' END AS reason, coalesce(h1, above[len(above)]) AS h2 FROM s5),
s7 AS (SELECT *, regexp_full_match(h2, '\\s*[^|]{{1,64}}\\|.+') AS piped FROM s6),
s8 AS (SELECT *, coalesce(sec2, CASE WHEN piped THEN trim(regexp_extract(h2, '^\\s*([^|]{{1,64}})\\|(.+)$', 1)) END) AS section,
  CASE WHEN piped THEN trim(regexp_extract(h2, '^\\s*([^|]{{1,64}})\\|(.+)$', 2)) ELSE h2 END AS headline,
  CASE WHEN regexp_full_match(post[len(post)], '[0-9]+') THEN CAST(post[len(post)] AS INTEGER) END AS comment_count,
  nullif(trim(array_to_string(list_filter(post, lambda x: NOT regexp_full_match(x, '[0-9]+'))[1:4], ' ')), '') AS body_snippet,
  CASE WHEN regexp_matches(published_raw, '(?i)[0-9]+\\s+(minutes?|hours?|days?)\\s+ago') THEN
    strftime(TIMESTAMP '2026-02-14 10:30:00' - to_seconds(CAST(regexp_extract(published_raw, '([0-9]+)\\s', 1) AS BIGINT)
      * CASE WHEN contains(published_raw, 'minute') THEN 60 WHEN contains(published_raw, 'hour') THEN 3600 ELSE 86400 END), '%Y-%m-%dT%H:%M:%S') || '+00:00'
  WHEN regexp_full_match(published_raw, '[0-9]{{1,2}} [A-Za-z]{{3}} [0-9]{{4}} - [0-9]{{1,2}}:[0-9]{{2}}[AP]M') THEN strftime(strptime(published_raw, '%d %b %Y - %I:%M%p'), '%Y-%m-%dT%H:%M:%S') || zone END AS published FROM s7),
s9 AS (SELECT *, name || ':' || sha1(name || '|' || lower(headline) || '|' || coalesce(published, '') || '|' || url)[1:16] AS story_id,
  CASE WHEN list_has_any(block, excl) THEN ['exclusive'] ELSE []::VARCHAR[] END AS tags,
  CASE WHEN list_has_any(block, spons) THEN 'sponsored' WHEN list_contains(opin, coalesce(section, '')) OR starts_with(headline, 'Opinion|') THEN 'opinion'
    WHEN regexp_matches(lower(headline || ' ' || coalesce(subheadline, '')), 'analysis|deep dive|explainer') THEN 'analysis'
    WHEN len(list_filter(block[1:2], lambda x: regexp_full_match(x, '[0-9]{{2}}:[0-9]{{2}}'))) > 0 THEN 'video' ELSE 'news' END AS content_type FROM s8),
story AS (SELECT *, CAST(page_seq AS BIGINT) * 4294967296 + ord - 1 AS seq,
  CASE WHEN content_type = 'opinion' THEN list_filter(list_transform(block, lambda x, i: CASE WHEN list_contains(opin, x) AND i > 1 THEN block[i - 1] END),
    lambda x: x IS NOT NULL AND regexp_full_match(x, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{1,2}}'))[1] END AS author,
  CASE WHEN headline IS NULL THEN 'STORY_SKIPPED_NO_HEADLINE' WHEN published IS NULL THEN 'DATE_PARSE_FAILED' END AS warning FROM s9),
d0 AS (SELECT *, regexp_replace(lower(headline), '\\s+', ' ', 'g') AS kh, published[1:10] AS kd, CASE WHEN published IS NOT NULL THEN nullif(lower(coalesce(section, '')), '') END AS ks,
  coalesce(depth, 999) * 100 - (CASE WHEN coalesce(subheadline, '') <> '' THEN 1 ELSE 0 END + CASE WHEN comment_count IS NOT NULL THEN 1 ELSE 0 END
    + least(length(coalesce(body_snippet, '')) // 80, 4) + len(tags)) AS rank FROM story WHERE headline IS NOT NULL),
d1 AS (SELECT *, min(rank) OVER (PARTITION BY crawl_id, kh, kd, ks ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY crawl_id, kh, kd, ks ORDER BY rank, seq) AS turn FROM d0),
d2 AS (SELECT crawl_id, kh, kd, ks, min(seq) AS first_seq, count(*) - 1 AS duplicates, coalesce(list_reverse(list(url ORDER BY seq) FILTER (best IS NULL OR rank < best)), []) AS won,
  coalesce(list(url ORDER BY seq) FILTER (rank >= best), []) AS lost FROM d1 GROUP BY ALL),
uniq AS (SELECT d1.*, first_seq, CAST(duplicates AS INTEGER) AS duplicates, array_to_string(list_concat(won, lost), ',') AS seen_on FROM d1 JOIN d2 ON d1.crawl_id = d2.crawl_id AND d1.kh = d2.kh AND d1.kd IS NOT DISTINCT FROM d2.kd AND d1.ks IS NOT DISTINCT FROM d2.ks WHERE turn = 1),
q0 AS (SELECT *, list_filter([CASE WHEN coalesce(headline, '') = '' THEN 'headline' END, CASE WHEN coalesce(section, '') = '' THEN 'section' END, CASE WHEN coalesce(subheadline, '') = '' THEN 'subheadline' END,
  CASE WHEN coalesce(published, '') = '' THEN 'published' END], lambda x: x IS NOT NULL) AS missing_fields FROM uniq),
scored AS (SELECT *, round(1.0::DOUBLE - 0.12::DOUBLE * len(missing_fields) - CASE WHEN reason LIKE '%fallback' THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN published IS NULL THEN 0.1::DOUBLE ELSE 0 END, 2) AS parse_confidence FROM q0)
"""


def oracles() -> dict[str, str]:
    s = _stages()
    return {
        "feed_stories": s + """SELECT crawl_id, CAST(row_number() OVER (PARTITION BY crawl_id ORDER BY coalesce(published, '') DESC, first_seq) AS INTEGER) AS position, story_id, headline, subheadline, section, published,
  published_raw, body_snippet, CAST(comment_count AS VARCHAR) AS comment_count, array_to_string(tags, ',') AS tags, content_type, author, url AS page_url, depth, seen_on, language, parse_confidence,
  array_to_string(missing_fields, ',') AS missing, reason AS segmentation_reason FROM scored""",
        "feed_meta": s + """SELECT p.*, CAST(coalesce(u.n, 0) AS BIGINT) AS stories_extracted, CAST(coalesce(f.c, 0) - coalesce(u.n, 0) AS BIGINT) AS duplicates_removed, CAST(noise AS BIGINT) AS noise_lines_stripped,
  CAST(rescued + coalesce(f.w, 0) AS BIGINT) AS parse_warnings FROM (SELECT * EXCLUDE (noise, rescued), noise, rescued FROM (SELECT crawl_id, min(start_url) AS start_url, min(name) AS source_profile,
  min(display_name) AS source_name, count(*) AS pages_crawled, sum(noise) AS noise, sum(len(rescued)) AS rescued FROM clean GROUP BY crawl_id)) p
  LEFT JOIN (SELECT crawl_id, count(headline) AS c, count(warning) AS w FROM story GROUP BY crawl_id) f USING (crawl_id) LEFT JOIN (SELECT crawl_id, count(*) AS n FROM uniq GROUP BY crawl_id) u USING (crawl_id)""".replace("SELECT p.*,", "SELECT p.crawl_id, start_url, CASE WHEN p.crawl_id % 2 = 0 THEN '2' ELSE '1.0.0' END AS parser_version, '2026-02-14T10:30:00Z' AS crawl_time_utc, source_profile, source_name, pages_crawled,"),
        "feed_times": """WITH c AS (SELECT c_custkey, c_custkey % 5 AS form, c_custkey % 24 AS h FROM customer),
  t AS (SELECT c_custkey, CASE form WHEN 1 THEN '+08:00' WHEN 2 THEN '-03:30' ELSE '+00:00' END AS zone, CASE form WHEN 0 THEN h * 3600000000 + 1800000000 WHEN 1 THEN h * 3600000000 + 1805250000 - 28800000000
    WHEN 2 THEN h * 3600000000 + 1800000000 + 12600000000 WHEN 3 THEN h * 3600000000 + 300500000 ELSE 0 END AS us FROM c)
  SELECT c_custkey, zone, strftime(TIMESTAMP '2026-02-14' + to_microseconds(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 <> 0 THEN '.' || lpad(CAST((us % 1000000 + 1000000) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS utc FROM t""",
        "feed_warnings": s + """SELECT crawl_id, page_seq, 0 AS kind, CAST(unnest(range(0, len(rescued))) AS INTEGER) AS i, 'STRIP_RULE_SKIPPED_STORY_SAFETY' AS code, unnest(rescued) AS example FROM clean
  UNION ALL SELECT crawl_id, page_seq, 1, CAST(ord - 1 AS INTEGER), warning, published_raw[1:120] FROM story WHERE warning IS NOT NULL""",
        "feed_noise_strip": s + "SELECT crawl_id, page_seq, array_to_string(kept, '|') AS kept, noise, CAST(len(rescued) AS INTEGER) AS rescued FROM clean",
        "feed_segments": s + "SELECT crawl_id, page_seq, CAST(ord - 1 AS INTEGER) AS ordinal, CAST(anc - 1 AS INTEGER) AS anchor, array_to_string(block, '|') AS block FROM seg",
        "feed_dedupe": s + "SELECT crawl_id, story_id, depth, duplicates, seen_on FROM uniq",
        "feed_quality": s + "SELECT content_type, reason AS segmentation_reason, parse_confidence, count(*) AS stories FROM scored GROUP BY ALL",
    }


ORACLES = oracles()
