"""Breadth-first crawl over stored pages, at most three levels deep, many crawls at once.

pages: url, and links array<string> (absolute, internal, in document order). seeds: crawl_id, start_url. Levels are
unrolled: each is a join of the frontier with the pages, so a level costs a shuffle however many crawls run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import bound
from weftline.operators.html import extract
from weftline.operators.urlguard import netloc


def url_key(url: Column) -> Column:
    """What makes two addresses one page: all but slashes at the end."""
    return F.regexp_replace(url, r"/+$", "")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def _keys(all_: Column) -> Column:
    return F.transform(all_, lambda x: x["key"])


def linked(pages: DataFrame, per_level: int) -> DataFrame:
    """One page of each key, the first by address, with what its links can contribute to a crawl.

    Links count on the page's own host only. No crawl takes more than ``per_level`` links of a page, and leaves out at
    most ``per_level`` + 1 keys, so that the links up to the first ``2 * per_level + 1`` distinct keys suffice.
    """
    extra = [c for c in pages.columns if c not in ("url", "links")]
    own = F.filter("links", lambda x: x.startswith("http") & (netloc(x) == F.col("host")))
    keyed = bound(F.array_distinct(own), lambda all_: F.transform(all_, lambda x: F.struct(x.alias("link"), url_key(x).alias("key"))))
    stop = lambda all_: F.get(F.array_distinct(_keys(all_)), F.lit(2 * per_level + 1))
    first = lambda all_: bound(stop(all_), lambda key: F.when(key.isNull(), all_).otherwise(F.slice(all_, F.lit(1), F.array_position(_keys(all_), key).cast("int") - 1)))
    d = pages.withColumn("host", netloc(F.col("url"))).select(url_key(F.col("url")).alias("key"), "url", "host", bound(keyed, first).alias("out"), *extra)
    return d.groupBy("key").agg(F.min_by(F.struct(F.col("url").alias("page_url"), "host", "out", *extra), F.col("url")).alias("p")).select("key", "p.*")


def started(seeds: DataFrame) -> DataFrame:
    """(crawl_id, key, start_host) of seeds."""
    return seeds.select("crawl_id", url_key(F.col("start_url")).alias("key"), netloc(F.col("start_url")).alias("start_host"))


def crawl(seeds: DataFrame, pages: DataFrame, depth: int = 3, per_level: int = 5) -> DataFrame:
    """(crawl_id, seq, depth, url, text?) of the pages visited.

    The second level is the first ``per_level`` links of the root that aren't the root itself; the third the first
    ``per_level`` of the ordered distinct links of all second-level pages that weren't visited when their page was
    finished. Links that lead nowhere, or to a page visited in between, use up their place.
    """
    depth, per_level = clamp(depth, 1, 3), clamp(per_level, 1, 20)
    known = linked(pages, per_level)
    extra = [c for c in pages.columns if c not in ("url", "links")]
    none = F.array().cast("array<struct<link:string,key:string>>")
    first_of_key = lambda all_: F.filter(all_, lambda x, i: F.array_position(_keys(all_), x["key"]) == i + 1)

    one = started(seeds).join(known, "key").withColumn("depth", F.lit(1)).withColumn("seq", F.lit(0))
    levels = [one]
    if depth > 1:
        # Links of a page on another host than the start's aren't followed.
        mine = F.when(F.col("host") == F.col("start_host"), F.filter("out", lambda x: x["key"] != F.col("key"))).otherwise(none)
        placed = one.select("crawl_id", "start_host", F.col("key").alias("root"), F.slice(mine, 1, per_level).alias("places"))
        # Of equal addresses among the places the first is visited.
        turns = F.filter(F.transform("places", lambda x, i: F.struct(i.alias("pos"), x.alias("key"), (F.array_position("places", x) == i + 1).alias("first"))), lambda x: x["first"])
        placed = placed.select("crawl_id", "start_host", "root", _keys(F.col("places")).alias("places"))
        two = placed.select("crawl_id", "start_host", "root", "places", F.inline(turns).alias("pos", "key", "first")).drop("first")
        two = two.join(known, "key").withColumn("depth", F.lit(2)).withColumn("seq", F.col("pos") + 1)
        levels.append(two)
    if depth > 2:
        # What was visited when a page was finished: the root and all places of its level up to its own.
        visited = lambda x: (x["key"] == F.col("root")) | F.array_contains(F.slice("places", F.lit(1), F.col("pos") + 1), x["key"])
        out = F.when(F.col("host") == F.col("start_host"), F.filter("out", lambda x: ~visited(x))).otherwise(none)
        each = two.groupBy("crawl_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.slice(out, 1, per_level).alias("out")))).alias("all"), F.min("places").alias("places"))
        wanted = F.slice(F.array_distinct(F.flatten(F.col("all.out"))), 1, per_level)
        ranked = bound(wanted, lambda all_: F.transform(all_, lambda x, i: F.struct((i + 1).alias("rank"), x["key"].alias("key"))))
        open_ = bound(F.filter(ranked, lambda x: ~F.array_contains("places", x["key"])), first_of_key)
        third = each.select("crawl_id", F.inline(open_).alias("rank", "key"))
        third = third.join(known.drop("host", "out"), "key").withColumn("depth", F.lit(3)).withColumn("seq", F.lit(per_level) + F.col("rank"))
        levels.append(third)
    shape = [x.select("crawl_id", F.col("seq").cast("int").alias("seq"), F.col("depth").cast("int").alias("depth"), F.col("page_url").alias("url"), *extra) for x in levels]
    found = shape[0]
    for level in shape[1:]:
        found = found.unionByName(level)
    return found


def crawl_site(seeds: DataFrame, pages: DataFrame, depth: int = 1, per_level: int = 5, wanted: tuple[str, ...] = ()) -> DataFrame:
    """A crawl over stored pages (url, html): what is ``wanted`` of each page visited, as ``page``. Links are read whenever
    the depth needs them, and taken out again at the end unless they are wanted."""
    depth = clamp(depth, 1, 3)
    asked = tuple(dict.fromkeys([*wanted, *(["links"] if depth > 1 else [])]))
    read = extract(pages.select("url", "html"), asked).drop("html")
    read = read.withColumn("links", F.transform(F.filter(F.coalesce("page.links", F.array().cast(read.schema["page"].dataType["links"].dataType)), lambda x: ~x["external"]), lambda x: x["url"]))
    found = crawl(seeds, read, depth, per_level)
    return found if "links" in wanted else found.withColumn("page", F.col("page").dropFields("links"))


def summary(visited: DataFrame) -> DataFrame:
    """By crawl: pages, characters of text, pages by depth."""
    by_depth = visited.groupBy("crawl_id", "depth").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    pairs = F.array_sort(F.collect_list(F.struct("depth", "n")))
    return by_depth.groupBy("crawl_id").agg(F.sum("n").alias("total_pages"), F.sum("chars").alias("total_text_length"), F.map_from_entries(pairs).alias("pages_by_depth"))


def truncate_pages(visited: DataFrame, max_chars: int, least: int = 2000) -> DataFrame:
    """Pages within a budget of characters a crawl: from the last page on, pages go while the rest is too long; the page
    that would be cut to fewer than ``least`` characters goes as a whole, else it is cut and the cutting ends."""
    back = Window.partitionBy("crawl_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    d = visited.withColumn("len", F.length("text")).withColumn("total", F.sum("len").over(Window.partitionBy("crawl_id")))
    d = d.withColumn("excess", F.col("total") - max_chars - F.coalesce(F.sum("len").over(back), F.lit(0)))
    kept = F.col("len") - F.col("excess")
    d = d.withColumn("state", F.when(F.col("excess") <= 0, "kept").when((F.col("seq") > 0) & (kept < least), "dropped").when((F.col("seq") > 0) | (kept > least), "cut").otherwise("kept"))
    return d.where("state <> 'dropped'").withColumn("text", F.when(F.col("state") == "cut", F.substring(F.col("text"), F.lit(1), kept.cast("int"))).otherwise(F.col("text"))).drop("len", "total", "excess")
