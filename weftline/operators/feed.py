"""News feed: crawl pages to deduplicated, quality-scored stories.

Segmentation works on the line array of each page with higher-order functions, so that it needs no shuffle; only the
deduplication moves rows, by crawl and key, and there a story is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import bound, lines, normalise, shortened, strip
from weftline.plans.profiles import GENERIC
from weftline.storage import fresh

#: What a crawl that names no version has, and how a story was found: fixed values.
PARSER_VERSION = "1.0.0"
ALIGNED = "date_anchor+heading_alignment"
FALLBACK = "date_anchor+nearest_preceding_line_fallback"

PAGE_SCHEMA = """crawl_id long, page_seq int, url string, depth int, text string, language string, meta map<string,string>,
  start_url string, crawl_time_utc string, parser_version string, source_profile_name string"""

#: Places of blocks on a page are below this.
_PAGE = 1 << 32
_DURATION = r"^\d{2}:\d{2}$"
_NAME = r"(?U)^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}$"
_RELATIVE = r"(?iU)(\d+)\s+(minutes?|hours?|days?)\s+ago"
_ABSOLUTE = r"(?U)^\d{1,2} \w{3} \d{4} - \d{1,2}:\d{2}(?i:[AP]M)$"


#: A date and, from there, a time with an offset as ISO 8601 writes them.
_ISO = r"^\s*(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?)?)?)(Z|[+-]\d{2}(?::?\d{2})?)?\s*$"
#: Patterns that are compiled once; further ones are compiled for every line.
_COMPILED = 64
_DIMENSION = 10_000


def _date_pattern(patterns: Column) -> Column:
    return F.concat(F.lit("(?iuU)"), F.array_join(F.transform(patterns, lambda x: F.concat(F.lit("(?:"), x, F.lit(")"))), "|"))


def with_profile(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pages with ``profile``; unknown and missing names get the generic one. The dimension has a row per source, and is
    broadcast as long as it has at most ``_DIMENSION`` rows: pages aren't moved for it, many of which have one profile."""
    small = profiles.limit(_DIMENSION + 1).count() <= _DIMENSION
    sent = F.broadcast if small else (lambda d: d)
    name, key = fresh("profile_name", pages), fresh("profile_key", pages)
    names = profiles.select(F.col("name").alias(name))
    rows = profiles.select(F.col("name").alias(key), F.struct(*profiles.columns).alias("profile"), _date_pattern(F.col("date_patterns")).alias("date_pattern"))
    named = pages.join(sent(names), F.col("source_profile_name") == F.col(name), "left").withColumn(key, F.coalesce(name, F.lit(GENERIC)))
    return named.join(sent(rows), key).drop(name, key)


def with_crawl_time(pages: DataFrame) -> DataFrame:
    """Pages with ``crawl_local``, the crawl's time on its own clock, and ``crawl_zone``, its offset, UTC where it has none. A
    missing time is now, in UTC; text that isn't an ISO date or time is an error."""
    told = F.nullif("crawl_time_utc", F.lit(""))
    clock = F.regexp_replace(F.regexp_extract(told, _ISO, 1), ",", ".")
    clock = F.try_to_timestamp(F.when(F.length(clock) == 13, F.concat(clock, F.lit(":00"))).otherwise(clock))
    zone = F.regexp_replace(F.regexp_extract(told, _ISO, 2), ":", "")
    # Fixed value: the text of the error.
    wrong = F.raise_error(F.lit("crawl_time_utc must be a valid ISO-8601 datetime string"))
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    local = F.when(told.isNull(), now).when(clock.isNotNull(), clock).otherwise(wrong.cast("timestamp"))
    offset = F.when(told.isNull() | zone.isin("", "Z"), "+00:00").otherwise(F.concat(F.left(zone, F.lit(3)), F.lit(":"), F.rpad(F.substring(zone, 4, 2), 2, "0")))
    return pages.withColumn("crawl_local", local).withColumn("crawl_zone", offset)


def crawl_utc(local: Column, zone: Column) -> Column:
    """The crawl's time in UTC, as ISO text with Z."""
    minutes = F.substring(zone, 2, 2).cast("long") * 60 + F.substring(zone, 5, 2).cast("long")
    at = F.timestamp_micros(F.unix_micros(local) - F.when(zone.startswith("-"), -minutes).otherwise(minutes) * 60_000_000)
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(at) % 1_000_000 != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("Z"))


def cleaned_lines(pages: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """Pages with ``kept`` lines, which of them are ``dates``, the number of ``noise`` lines dropped, and ``rescued``
    ones: noise beside a date stays. ``patterns``: date patterns known before, which are compiled once and not by line."""

    def dated(x: Column) -> Column:
        own, found = F.col("date_pattern"), None
        for p in patterns:
            found = (F if found is None else found).when(own == p, x.rlike(p))
        return F.rlike(x, own) if found is None else found.otherwise(F.rlike(x, own))

    noise = lambda x: (x != "") & (
        F.array_contains(F.col("profile.noise_markers"), x) | x.startswith("Photo:") | x.startswith("Illustration:") | x.rlike(_DURATION)
        | F.lower(x).contains("sentry-trace") | F.lower(x).contains("baggage") | F.lower(x).contains("appstore")
    )
    # Every line is matched once: each array is bound before it is looked at by place.
    told = F.transform(lines(F.col("text")), lambda x: F.struct(x.alias("line"), dated(x).alias("date"), noise(x).alias("noise")))
    near = lambda all_, i: F.coalesce(F.get(all_, i)["date"], F.lit(False))
    state = lambda all_: F.transform(all_, lambda x, i: F.struct(x["line"].alias("line"), x["date"].alias("date"), F.when(~x["noise"], 0).when(near(all_, i - 1) | near(all_, i + 1), 1).otherwise(2).alias("state")))
    parts = lambda all_: F.struct(
        F.filter(all_, lambda x: (x["state"] < 2) & (x["line"] != "")).alias("kept"),
        F.size(F.filter(all_, lambda x: x["state"] == 2)).alias("noise"),
        F.transform(F.filter(all_, lambda x: x["state"] == 1), lambda x: F.left(x["line"], F.lit(120))).alias("rescued"),
    )
    d = pages.withColumn("clean", bound(bound(told, state), parts))
    return d.withColumns({"kept": F.col("clean.kept.line"), "dates": F.col("clean.kept.date"), "noise": F.col("clean.noise"), "rescued": F.col("clean.rescued")}).drop("clean")


def segments(cleaned: DataFrame, outer: bool = False) -> DataFrame:
    """One row for each date line: its ``block`` reaches from behind the date line before to before the one after, so
    that neighbouring blocks overlap; ``anchor`` is the place of the date line in it. ``outer``: pages without a date
    line give a row too."""
    places = F.filter(F.transform("dates", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    last = F.size("kept") - 1
    block = lambda all_: F.transform(
        all_,
        lambda a, i: F.struct(
            i.alias("ordinal"), F.coalesce(F.get(all_, i - 1) + 1, F.lit(0)).alias("first"), F.coalesce(F.get(all_, i + 1) - 1, last).alias("last"), a.alias("at"),
        ),
    )
    each = cleaned.withColumn("b", (F.explode_outer if outer else F.explode)(bound(places, block)))
    return (
        each.withColumn("block", F.slice("kept", F.col("b.first") + 1, F.col("b.last") - F.col("b.first") + 1))
        .withColumn("anchor", F.col("b.at") - F.col("b.first")).withColumn("ordinal", F.col("b.ordinal")).drop("b", "kept", "dates")
    )


def _published(raw: Column, local: Column, zone: Column, profile_offset: Column) -> Column:
    """ISO text with offset, or null: relative times count from the crawl in its offset, absolute ones are local."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    count = F.regexp_extract(raw, _RELATIVE, 1)
    unit = F.lower(F.regexp_extract(raw, _RELATIVE, 2))
    step = F.when(unit.startswith("minute"), 60).when(unit.startswith("hour"), 3600).otherwise(86400)
    moved = F.timestamp_micros(F.unix_micros(local) - F.try_to_number(count, F.lit("9999999999")).cast("long") * step * 1_000_000)
    fraction = F.when(F.unix_micros(local) % 1_000_000 != 0, F.date_format(moved, ".SSSSSS")).otherwise("")
    relative = F.concat(F.date_format(moved, iso), fraction, zone)
    tidy = F.regexp_replace(raw, r"(?U)\s+", " ")
    stamp = F.try_to_timestamp(F.regexp_replace(F.initcap(tidy), r"(?i)\s*([ap])m$", " $1M"), F.lit("d MMM yyyy - h:mm a"))
    absolute = F.when(tidy.rlike(_ABSOLUTE), F.concat(F.date_format(stamp, iso), profile_offset))
    return F.when(count != "", relative).otherwise(absolute)


def stories(segmented: DataFrame, also: tuple = ()) -> DataFrame:
    """Blocks as stories, with ``seq``, the order in the crawl, and ``warning``; a block without a headline has only that.
    ``also``: other columns to keep."""
    p = lambda name: F.col(f"profile.{name}")
    d = segmented.withColumn("published_raw", F.get("block", "anchor"))
    d = d.withColumn("above", F.slice("block", F.lit(1), F.col("anchor"))).withColumn("post", F.slice("block", F.col("anchor") + 2, F.size("block")))
    d = d.withColumn("pre", F.filter("above", lambda x: ~F.array_contains(p("exclusive_markers"), x) & ~F.array_contains(p("sponsored_markers"), x)))
    other = F.array_position(F.transform("pre", lambda x: F.array_contains(p("section_labels"), x)), F.lit(False))
    d = d.withColumn("run", F.when(other > 0, other - 1).otherwise(F.size("pre")).cast("int"))
    d = d.withColumn("section", F.get("pre", F.col("run") - 1)).withColumn("rem", F.slice("pre", F.col("run") + 1, F.size("pre")))
    d = d.withColumn("pipe", F.array_position(F.transform("rem", lambda x: x.contains("|")), F.lit(True)).cast("int"))
    d = d.withColumn("first", F.greatest("pipe", F.lit(1)))
    label = F.get("rem", F.col("pipe") - 2)
    d = d.withColumn("section", F.coalesce("section", F.when((F.col("pipe") > 1) & F.array_contains(p("opinion_labels"), label), label)))
    d = d.withColumn("headline", F.get("rem", F.col("first") - 1)).withColumn("next", F.get("rem", "first"))
    d = d.withColumn("subheadline", F.when(~F.array_contains(p("opinion_labels"), F.col("next")) & ~F.col("next").rlike(_NAME), F.col("next")))
    d = d.withColumn("reason", F.when(F.col("headline").isNull(), FALLBACK).otherwise(ALIGNED))
    d = d.withColumn("headline", F.coalesce("headline", F.get("above", F.size("above") - 1)))
    split = r"^\s*([^|]{1,64})\|(.+)$"
    piped = F.col("headline").rlike(split)
    d = d.withColumn("section", F.coalesce("section", F.when(piped, strip(F.regexp_extract("headline", split, 1)))))
    d = d.withColumn("headline", F.when(piped, strip(F.regexp_extract("headline", split, 2))).otherwise(F.col("headline")))
    number = r"(?U)^\d+$"
    last = F.get("post", F.size("post") - 1)
    d = d.withColumn("comment_count", F.when(last.rlike(number), last.try_cast("int")))
    body = F.array_join(F.slice(F.filter("post", lambda x: ~x.rlike(number)), 1, 4), " ")
    d = d.withColumn("body_snippet", F.nullif(shortened(strip(body), 400), F.lit("")))
    d = d.withColumn("published", _published(F.col("published_raw"), F.col("crawl_local"), F.col("crawl_zone"), p("utc_offset")))
    d = d.withColumn("language", F.coalesce("language", F.col("meta")["language"]))
    parts = [F.coalesce(x, F.lit("")) for x in (p("name"), F.lower("headline"), F.col("published"), F.col("url"))]
    d = d.withColumn("story_id", F.concat(p("name"), F.lit(":"), F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(16))))
    d = d.withColumn("tags", F.when(F.arrays_overlap("block", p("exclusive_markers")), F.array(F.lit("exclusive"))).otherwise(F.array().cast("array<string>")))
    both = F.lower(F.concat_ws(" ", "headline", F.coalesce("subheadline", F.lit(""))))
    kind = (
        F.when(F.arrays_overlap("block", p("sponsored_markers")), "sponsored")
        .when(F.array_contains(p("opinion_labels"), F.coalesce("section", F.lit(""))) | F.col("headline").startswith("Opinion|"), "opinion")
        .when(both.contains("analysis") | both.contains("deep dive") | both.contains("explainer"), "analysis")
        .when(F.exists(F.slice("block", 1, 2), lambda x: x.rlike(_DURATION)), "video")
        .otherwise("news")
    )
    d = d.withColumn("content_type", kind)
    before = F.filter(
        F.transform("block", lambda x, i: F.when(F.array_contains(p("opinion_labels"), x) & (i > 0), F.get("block", i - 1))),
        lambda x: x.isNotNull() & x.rlike(_NAME),
    )
    d = d.withColumn("author", F.when(F.col("content_type") == "opinion", F.get(before, F.lit(0))))
    warning = F.when(F.col("headline").isNull(), F.struct(F.lit("STORY_SKIPPED_NO_HEADLINE").alias("code"), F.left("published_raw", F.lit(120)).alias("example")))
    warning = warning.when(F.col("published").isNull(), F.struct(F.lit("DATE_PARSE_FAILED").alias("code"), F.left("published_raw", F.lit(120)).alias("example")))
    seen = F.struct(F.col("url").alias("page_url"), F.col("depth").alias("crawl_depth"))
    return d.select(
        "crawl_id", (F.col("page_seq").cast("long") * _PAGE + F.col("ordinal")).alias("seq"), "story_id", "headline", "subheadline", "section", "published", "published_raw",
        "body_snippet", "comment_count", "tags", "content_type", "author", "start_url", "url", "depth", seen.alias("seen"), "language", "reason", warning.alias("warning"), *[c for c in also if c in d.columns],
    )


def richness(d: DataFrame) -> Column:
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0)
    body = F.least(F.floor(F.length(F.coalesce("body_snippet", F.lit(""))) / 80), F.lit(4))
    return (some("subheadline") + F.when(F.col("comment_count").isNotNull(), 1).otherwise(0) + body + F.size("tags")).cast("int")


def story_key(d: DataFrame) -> Column:
    """What makes two stories one: headline, day, and with a day the section."""
    day = F.nullif(F.left("published", F.lit(10)), F.lit(""))
    section = F.when(day.isNotNull(), F.nullif(normalise(F.coalesce("section", F.lit(""))), F.lit("")))
    return F.struct(normalise(F.col("headline")).alias("h"), day.alias("d"), section.alias("s"))


def deduplicate(found: DataFrame) -> DataFrame:
    """One story of each key: the least deep, then the richest, then the first. ``seen_on_pages`` gathers the pages of all:
    a story that wins over those before puts its page in front, another one's is appended.

    The winners are the stories whose rank is below the smallest of those before them. With that known, the pages are two
    lists, the winners' backwards and the others' in order, which Spark gathers in any order and from any parts.
    """
    # Blocks without a headline are groups of their own and go after the grouping: a filter before it would be pushed down
    # to the blocks, where all of the headline's steps would be computed twice.
    key = story_key(found)
    key = key.withField("h", F.coalesce(key["h"], F.concat(F.lit("\0"), F.col("seq").cast("string"))))
    d = found.withColumn("key", key)
    d = d.withColumn("rank", F.struct(F.coalesce("depth", F.lit(999)).alias("depth"), (-richness(d)).alias("poor")))
    told = [c for c in d.columns if c not in ("crawl_id", "key", "seen", "warning", "rank")]
    before = Window.partitionBy("crawl_id", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("best_before", F.min("rank").over(before)).withColumn("wins", F.col("best_before").isNull() | (F.col("rank") < F.col("best_before")))
    place = F.struct("seq", "seen")
    d = d.groupBy("crawl_id", "key").agg(
        F.min_by(F.struct(*told), F.struct("rank", "seq")).alias("best"), F.min("seq").alias("first_seq"), F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("wins"), place)), asc=False).alias("won"), F.sort_array(F.collect_list(F.when(~F.col("wins"), place))).alias("lost"),
    ).where("best.headline IS NOT NULL")
    pages = F.transform(F.concat("won", "lost"), lambda x: x["seen"])
    return d.select("crawl_id", "best.*", "first_seq", pages.alias("seen_on_pages"), (F.col("n") - 1).cast("int").alias("duplicates"))


def quality(d: DataFrame) -> DataFrame:
    """``parse_confidence``, ``missing_fields`` and ``segmentation_reason``."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("headline", "section", "subheadline", "published")]), lambda x: x.isNotNull())
    undated = F.when(F.col("published").isNull() & (F.col("published_raw") != ""), 0.1).otherwise(0.0)
    score = 1.0 - 0.12 * F.size("missing_fields") - F.when(F.col("reason") == FALLBACK, 0.15).otherwise(0.0) - undated
    return d.withColumn("missing_fields", missing).withColumn("parse_confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 2)))).withColumnRenamed("reason", "segmentation_reason")


class Feed:
    """The stages of the feed of some pages (see ``PAGE_SCHEMA``), each a DataFrame."""

    def __init__(self, pages: DataFrame, profiles: DataFrame):
        self.pages = pages
        patterns = [r[0] for r in profiles.select(_date_pattern(F.col("date_patterns"))).distinct().limit(_COMPILED).collect()]
        self.cleaned = cleaned_lines(with_profile(with_crawl_time(pages), profiles), patterns)
        self.segments = segments(self.cleaned)
        self.found = stories(self.segments)
        self.unique = deduplicate(self.found)
        self.stories = quality(self.unique)

    def ordered(self) -> DataFrame:
        """Stories with their place in the feed of their crawl: the latest first, by the text of their date."""
        by = Window.partitionBy("crawl_id").orderBy(F.coalesce("published", F.lit("")).desc(), "first_seq")
        return self.stories.withColumn("position", F.row_number().over(by))

    def nested(self) -> DataFrame:
        """Stories in the nested shape of the feed document."""
        d = self.ordered()
        return d.select(
            "crawl_id", "position", "story_id", "headline", "subheadline", "section", "published", "published_raw", "body_snippet", "comment_count", "tags", "content_type", "author",
            F.struct(F.col("start_url").alias("root_url"), F.col("url").alias("page_url"), F.col("depth").alias("crawl_depth")).alias("provenance"),
            "seen_on_pages", "language", F.struct("parse_confidence", "missing_fields", "segmentation_reason").alias("parse_quality"),
        )

    def warnings(self) -> DataFrame:
        """(crawl_id, code, example) in order of ``at``: by page, rescued noise lines first, then stories."""
        rescued = self.cleaned.select("crawl_id", "page_seq", F.posexplode("rescued").alias("i", "example")).select(
            "crawl_id", F.struct("page_seq", F.lit(0).alias("kind"), F.col("i")).alias("at"), F.lit("STRIP_RULE_SKIPPED_STORY_SAFETY").alias("code"), "example"
        )
        # As generated rows, since a filter on the warning would be pushed down to the blocks.
        told = self.found.select(
            "crawl_id", F.struct(F.shiftright("seq", 32).cast("int").alias("page_seq"), F.lit(1).alias("kind"), (F.col("seq") % _PAGE).cast("int").alias("i")).alias("at"),
            F.inline(F.when(F.col("warning").isNotNull(), F.array("warning"))).alias("code", "example"),
        )
        return rescued.unionByName(told)

    def meta(self) -> DataFrame:
        """A row for each crawl: what was read, found, merged and dropped. The pages are read once: what belongs to a page
        goes with the first of its rows."""
        page = {"crawl_utc": crawl_utc(F.col("crawl_local"), F.col("crawl_zone")), "version": F.coalesce(F.nullif("parser_version", F.lit("")), F.lit(PARSER_VERSION)), "source_profile": F.col("profile.name"), "source_name": F.col("profile.display_name"), "rescued": F.size("rescued"), "opens": F.coalesce("ordinal", F.lit(0)) == 0}
        rows = stories(segments(self.cleaned, outer=True).withColumns(page), ("noise", *page))
        once = lambda c: F.sum(F.when(F.col("opens"), F.col(c)))
        least = ("start_url", "version", "source_profile", "source_name", "crawl_utc")
        by_key = rows.withColumn("key", F.when(F.col("headline").isNotNull(), story_key(rows))).groupBy("crawl_id", "key").agg(
            *[F.min(c).alias(c) for c in least], F.count_if("opens").alias("pages"), once("noise").alias("noise"), once("rescued").alias("rescued"),
            F.count("headline").alias("candidates"), F.count_if(F.col("warning").isNotNull() & F.col("published_raw").isNotNull()).alias("told"),
        )
        total = by_key.groupBy("crawl_id").agg(
            *[F.min(c).alias(c) for c in least], F.sum("pages").alias("pages_crawled"), F.count("key").alias("stories_extracted"), (F.sum("candidates") - F.count("key")).alias("duplicates_removed"),
            F.coalesce(F.sum("noise"), F.lit(0)).cast("long").alias("noise_lines_stripped"), (F.coalesce(F.sum("rescued"), F.lit(0)) + F.sum("told")).cast("long").alias("parse_warnings"),
        )
        return total.withColumnsRenamed({"version": "parser_version", "crawl_utc": "crawl_time_utc"}).select("crawl_id", "start_url", "parser_version", "source_profile", "source_name", "crawl_time_utc", "pages_crawled", "stories_extracted", "duplicates_removed", "noise_lines_stripped", "parse_warnings")
