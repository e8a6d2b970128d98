"""The feed on pages with known stories."""

import random

import pytest

from weftline.operators.feed import PAGE_SCHEMA, Feed
from weftline.plans.profiles import missing_keys, profiles


def feed(spark, pages, profile="scmp", when="2026-02-14T10:30:00Z"):
    rows = [(1, i + 1, f"http://a/{i + 1}", depth, text, None, {}, "http://a", when, "v", profile) for i, (depth, text) in enumerate(pages)]
    return Feed(spark.createDataFrame(rows, PAGE_SCHEMA), profiles(spark))


def one(spark, text, **kw):
    return feed(spark, [(1, text)], **kw).ordered().collect()[0]


STORY = "Companies\nBig story\nSub line\n13 Feb 2026 - 10:15PM\nBody text\nmore\n48"


def test_fields(spark):
    r = one(spark, STORY)
    assert (r.section, r.headline, r.subheadline, r.comment_count, r.body_snippet) == ("Companies", "Big story", "Sub line", 48, "Body text more")
    assert r.published == "2026-02-13T22:15:00+08:00" and r.parse_confidence == 1.0 and r.content_type == "news"


def test_duplicates_keep_the_least_deep(spark):
    f = feed(spark, [(2, STORY), (1, STORY), (3, STORY)])
    r = f.ordered().collect()
    assert len(r) == 1 and r[0].depth == 1 and r[0].duplicates == 2
    assert [x.page_url for x in r[0].seen_on_pages] == ["http://a/2", "http://a/1", "http://a/3"]
    m = f.meta().collect()[0]
    assert (m.pages_crawled, m.stories_extracted, m.duplicates_removed) == (3, 1, 2)


@pytest.mark.parametrize(
    ("line", "published"),
    [
        ("2 hours ago", "2026-02-14T08:30:00+00:00"), ("45 minutes ago, updated", "2026-02-14T09:45:00+00:00"), ("3 Feb 2026 - 1:05am", "2026-02-03T01:05:00+08:00"),
        ("13 February 2026 - 10:15PM", None), ("on 13 Feb 2026 - 10:15PM", None),
    ],
)
def test_dates(spark, line, published):
    assert one(spark, f"Head\n{line}").published == published


def test_relative_dates_keep_the_crawl_offset(spark):
    assert one(spark, "Head\n1 hour ago", when="2026-02-14T10:30:00.500000+02:00").published == "2026-02-14T09:30:00.500000+02:00"


def test_crawl_times(spark):
    meta = lambda when: feed(spark, [(1, STORY)], when=when).meta().collect()[0]
    assert meta("2026-02-14T10:30:00+08:00").crawl_time_utc == "2026-02-14T02:30:00Z"
    assert meta(None).crawl_time_utc[:2] == meta("").crawl_time_utc[:2] == "20" and meta(None).crawl_time_utc.endswith("Z")
    for bad in ("yesterday", "2026-13-01T00:00:00Z", "14.02.2026"):
        with pytest.raises(Exception, match="must be a valid ISO-8601"):
            meta(bad)
        with pytest.raises(Exception, match="must be a valid ISO-8601"):
            feed(spark, [(1, "Head\n2 hours ago")], when=bad).ordered().collect()


def test_parser_version_has_a_default(spark):
    rows = [(c, 1, "u", 1, STORY, None, {}, "http://a", None, v, "scmp") for c, v in ((1, None), (2, ""), (3, "7"))]
    got = Feed(spark.createDataFrame(rows, PAGE_SCHEMA), profiles(spark)).meta().collect()
    assert {r.crawl_id: r.parser_version for r in got} == {1: "1.0.0", 2: "1.0.0", 3: "7"}


def fold(stories):
    """Pages as a fold over the stories of a key in order gives them: a winner's page goes in front."""
    pages, best = [], None
    for rank, page in stories:
        pages, best = ([page, *pages], rank) if best is None or rank < best else ([*pages, page], best)
    return pages


def test_seen_pages_are_a_fold(spark):
    r = random.Random(1)
    depths = [r.choice([1, 2, 3, 3, 3, 4, 5]) for _ in range(400)]
    depths[:3] = [5, 5, 4]
    found = feed(spark, [(d, STORY) for d in depths]).unique.collect()
    assert len(found) == 1 and [x.page_url for x in found[0].seen_on_pages] == fold([(d, f"http://a/{i + 1}") for i, d in enumerate(depths)])
    assert found[0].duplicates == 399 and found[0].url == f"http://a/{depths.index(1) + 1}"


def test_many_profiles(spark):
    """A dimension of many sources, with more date patterns than are compiled beforehand."""
    base = profiles(spark).where("name = 'scmp'").first().asDict()
    rows = [{**base, "name": f"n{i}", "date_patterns": [f"on day {i}$"]} for i in range(100)] + [{**base, "name": "generic"}]
    pages = [(i, 1, "u", 1, f"Head\non day {i}\nx\non day {i + 1}", None, {}, "http://a", None, "v", f"n{i}") for i in range(100)]
    got = Feed(spark.createDataFrame(pages, PAGE_SCHEMA), spark.createDataFrame(rows, profiles(spark).schema)).cleaned.collect()
    assert len(got) == 100 and all(r.dates == [False, True, False, False] for r in got)


def test_opinion_with_author_and_pipe(spark):
    r = one(spark, "Jane Doe\nOpinion\nOpinion | What now\n13 Feb 2026 - 10:15PM")
    assert (r.headline, r.section, r.content_type, r.author) == ("What now", "Opinion", "opinion", "Jane Doe")


def test_noise_goes_unless_beside_a_date(spark):
    f = feed(spark, [(1, "Photo: x\nTRENDING TOPICS\n12:34\n13 Feb 2026 - 10:15PM\nbody\nsentry-trace 1\n\nend")])
    r = f.cleaned.collect()[0]
    assert r.noise == 3 and r.rescued == ["12:34"]
    assert f.ordered().collect()[0].content_type == "video"


def test_overlapping_blocks(spark):
    found = feed(spark, [(1, "First\n13 Feb 2026 - 10:15PM\nSecond\n12 Feb 2026 - 10:15PM\nend")]).ordered().collect()
    assert [(r.headline, r.body_snippet) for r in found] == [("First", "Second"), ("Second", "end")]


def test_without_headline_or_dates(spark):
    f = feed(spark, [(1, "13 Feb 2026 - 10:15PM\nbody"), (1, "no date at all"), (1, None)])
    assert f.ordered().count() == 0
    assert [w.code for w in f.warnings().collect()] == ["STORY_SKIPPED_NO_HEADLINE"]
    assert f.meta().collect()[0].pages_crawled == 3


def test_fallback_headline(spark):
    r = one(spark, "Exclusive\n13 Feb 2026 - 10:15PM\nx")
    assert r.headline == "Exclusive" and r.segmentation_reason.endswith("fallback") and r.tags == ["exclusive"]
    assert r.parse_confidence == 0.61


def test_unknown_profile_is_generic(spark):
    r = one(spark, "Head\nFebruary 13, 2026\nx", profile="nobody")
    assert r.published is None and r.story_id.startswith("generic:") and r.missing_fields == ["section", "subheadline", "published"]
    assert missing_keys({"name": 1})[:2] == ["display_name", "timezone"] and len(missing_keys({})) == 10


def test_empty(spark):
    f = feed(spark, [])
    assert f.ordered().count() == f.warnings().count() == f.meta().count() == 0
