"""Pages, robots, guards, crawl, sessions, limits and obfuscation on small inputs."""

import hashlib
from collections import deque

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.functions import classify, dom, obfuscate, text
from weftline.operators import crawl, html, metrics, retention, robots, sessions, urlguard
from weftline.plans.web_queries import ORACLES, QUERIES
from weftline.sources import readers
from weftline.streaming import limits

PAGE = """<html lang="en"><head><title>T &amp; U</title><meta name="d" content="1"><meta name="d" content="2"></head><body><nav id="menu"><a href="/a">A</a><a href="/a">again</a><a href="#x">x</a></nav>
<h2>Second</h2><h1 id="top">First</h1><div class="top-ads">buy</div><p>Read more</p><p>Text <b>bold</b></p><img src="i.png" alt="pic"><a href="http://other/z" title="t">Z</a>
<form id="f" action="/go"><input name="q" required><select name="s"></select></form><script>var x</script></body></html>"""


def extracted(spark, page=PAGE, **kw):
    return html.extract(spark.createDataFrame([("http://h/p/", page)], "url string, html string"), **kw).select("page.*").collect()[0]


def test_extract(spark):
    r = extracted(spark)
    assert (r.title, r.language, r.meta) == ("T & U", "en", {"d": "2"})
    assert [(h.level, h.text) for h in r.headings] == [(1, "First"), (2, "Second")]
    assert [(x.url, x.external) for x in r.links] == [("http://h/a", False), ("http://other/z", True)]
    assert r.images[0].url == "http://h/p/i.png" and "var x" not in r.text and "buy" in r.text


def test_bare_references():
    page = "<title>a&amp;b&ampc &#65;&#65 &l</title><a href='?x&copy=1&amp;y'>z &amp</a><script>a&&b&amp</script><!-- <script> & --> <p>&copy</p>"
    root, cut = dom.parse(page), dom.parse(page, bare_references=False)
    assert dom.title(root) == "a&b&c AA &l" and dom.title(cut) == "a&b&ampc A&#65 &l"
    assert cut.text("|") == "a&b&ampc A&#65 &l|z &amp|&copy" and root.find_all("p")[0].text() == "©"
    assert cut.find_all("a")[0].attrs["href"] == "?x&copy=1&y"
    assert [x.find_all("script")[0].children for x in (root, cut)] == [["a&&b&amp"]] * 2


@pytest.mark.parametrize("name", ["html_headings", "html_noise", "html_text", "html_outline", "html_sections", "html_title_lang"])
def test_pages_with_cut_references(spark, tmp_path, name):
    """Pages whose titles were cut inside of a reference, against the SQL."""
    form = '<html lang="en"><head><title>{0}</title><style>p{{x}}</style></head><body><nav><a href="/a">A</a></nav><div class="ad">buy</div><article><h1>{0}</h1><p>x &amp; y {0}</p></article><footer>&copy; f</footer></body></html>'
    pages = [(i, f"http://h/{i}", form.format(t)) for i, t in enumerate(("T &amp;&amp", "T &am", "T &amp; U", "T &quot", "T &lt;&l", "&"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_noise_filter(spark):
    r = extracted(spark, filter_noise=True)
    assert "buy" not in r.text and "Read more" not in r.text and "bold" in r.text
    assert extracted(spark, "<p>plain</p>", filter_noise=True).text == extracted(spark, "<p>plain</p>").text


def test_selectors(spark):
    assert extracted(spark, selector="p b").text == "bold"
    assert extracted(spark, selector="#nothing").error.startswith("Selector did not match")
    assert extracted(spark, selector="p >").error.startswith("Invalid selector")
    assert extracted(spark, None).text == ""


def test_selectors_of_one_parse(spark, monkeypatch):
    """Each selector as alone, a page parsed once."""
    selectors = ("p b", "#nothing", "p >", "nav a", "h2, h1")
    pages = spark.createDataFrame([("http://h/p/", PAGE), ("u", "<p>x<b>y</b>"), ("v", None)], "url string, html string")
    got = html.selected(pages, selectors).select("url", "found.selector", "found.title", "found.language", "found.text", "found.error").collect()
    want = [(r[0], s, *r[1:]) for s in selectors for r in html.extract(pages, (), selector=s).select("url", "page.title", "page.language", "page.text", "page.error").collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) == 15
    parsed, parse = [], dom.parse
    monkeypatch.setattr(dom, "parse", lambda page: parsed.append(page) or parse(page))
    assert [x["text"] for x in html.read_selected(PAGE, selectors)][0] == "bold" and parsed == [PAGE]


def test_structure(spark):
    s = html.structure(spark.createDataFrame([("http://h/p/", PAGE)], "url string, html string")).select("structure.*").collect()[0]
    assert [x.url for x in s.navigation] == ["http://h/a"] and [x.tag for x in s.sections] == ["nav"]
    assert s.forms[0].method == "GET" and [(f.type, f.required) for f in s.forms[0].fields] == [("text", True), ("select", False)]
    assert [x.id for x in s.outline] == ["top", None] and len(s.external_links) == 1


@pytest.mark.parametrize(("attrs", "kept"), [('class="address"', False), ('class="thread-list"', False), ('id="adslot1"', True), ('class="bread"', True), ('id="download"', False)])
def test_advert_words_are_bounded_on_one_side(attrs, kept):
    root = dom.parse(f"<div {attrs}>x</div>")
    dom.drop_adverts(root)
    assert (root.text() == "x") is kept


ROBOTS = "User-agent: *\nDisallow: /a\nAllow: /a/b$\nCrawl-delay: x\nDisallow:\n\nUser-agent: one\nCrawl-delay: 5\nUser-agent: two # c\nDisallow: /*.pdf\nSitemap: http://s\nUser-agent: last\nCrawl-delay: 1"


@pytest.mark.parametrize(
    ("agent", "url", "allowed"),
    [("*", "http://h/a/x", False), ("*", "http://h/a/b", True), ("*", "http://h/a/bc", False), ("one", "http://h/x.pdf?y", False), ("two-more", "http://h/a", True), ("zzz", "http://h", True), ("last", "http://h/a", False)],
)
def test_robots(spark, agent, url, allowed):
    found = robots.groups(robots.parse(spark.createDataFrame([("h", ROBOTS)], "host string, body string")))
    urls = spark.createDataFrame([("h", url), ("none", url)], "host string, url string")
    r = {x.host: x for x in robots.check(urls, robots.agent_groups(found, agent)).collect()}
    assert r["h"].allowed is allowed and r["none"].allowed is True
    assert r["h"].crawl_delay == (5.0 if agent in ("one", "two-more") else None)


def test_addresses(spark):
    rows = [("10.1.2.3", True), ("172.32.0.1", False), ("256.1.1.1", False), ("::1", True), ("fe80::1", True), ("::ffff:192.168.1.1", True), ("2001:db8::1", False), ("::ffff:8.8.8.8", False), ("x", False), (None, False)]
    got = urlguard.blocked(spark.createDataFrame(rows, "a string, want boolean"), "a").collect()
    assert [(r.a, r.blocked) for r in got] == [(r.a, r.want) for r in got]


def test_crawl(spark):
    pages = [("http://h/", ["http://h/a", "http://h/b/", "http://h/gone", "http://o/x"]), ("http://h/a", ["http://h/", "http://h/c", "http://h/b"]), ("http://h/b", ["http://h/c/", "http://h/d"]), ("http://h/c", []), ("http://h/d", [])]
    d = spark.createDataFrame(pages, "url string, links array<string>").withColumn("text", F.lit("12345"))
    seeds = spark.createDataFrame([(1, "http://h/"), (2, "http://missing")], "crawl_id long, start_url string")
    found = crawl.crawl(seeds, d, 3, 20).orderBy("seq").collect()
    assert [(r.depth, r.url) for r in found] == [(1, "http://h/"), (2, "http://h/a"), (2, "http://h/b"), (3, "http://h/c"), (3, "http://h/d")]
    assert crawl.crawl(seeds, d, 1, 20).count() == 1 and crawl.crawl(seeds, d, 2, 1).count() == 2
    s = crawl.summary(crawl.crawl(seeds, d, 3, 20)).collect()[0]
    assert (s.total_pages, s.total_text_length, s.pages_by_depth) == (5, 25, {1: 1, 2: 2, 3: 2})


def test_sessions(spark):
    d = sessions.stored(spark.createDataFrame([("s", "u", "g", "t", "x" * 250), ("e", "u", None, "t", "")], "session_id string, url string, grp string, created_at string, content string"), 100)
    assert [len(r.chunk) for r in sessions.chunks(d).where("session_id = 's'").orderBy("chunk_index").collect()] == [100, 100, 50]
    assert {r.session_id: r.content for r in sessions.joined(sessions.chunks(d)).collect()} == {"s": "x" * 250, "e": ""}
    wanted = spark.createDataFrame([("s", 2), ("s", 99)], "session_id string, chunk_index int")
    assert {r.chunk_index: r.error_code for r in sessions.chunk(d, wanted).collect()} == {2: None, 99: "INVALID_CHUNK_INDEX"}
    assert [r.session_id for r in sessions.info(d, ["other"]).collect()] == ["e"] and sessions.info(d).count() == 2
    assert sessions.listed(d, ["g"]).count() == 1
    assert {r.session_id: r.error_code for r in sessions.whole(d, 100).collect()} == {"s": "CONTENT_TOO_LARGE", "e": None}


def test_retention(spark):
    rows = [(f"g{i}", f"2026-01-0{i}", 24 * 1024, None, True, "a") for i in (1, 2, 3)] + [("o", None, 10, None, False, "a")]
    d = spark.createDataFrame(rows, "guid string, created_at string, size long, grp string, has_metadata boolean, scope string")
    plan = retention.prune_plan(d, 0.05 * retention.MB)
    assert [r.guid for r in plan.where("deleted").collect()] == ["g1"]
    s = retention.prune_summary(plan, 0.05 * retention.MB).collect()[0]
    assert (s.deleted, s.orphans, s.exit_code) == (1, 1, 0)
    assert retention.exit_code(0, 1, None) == 1 and retention.exit_code(1, 3600, 5) == 2 and retention.exit_code(1, 3600, 5000) is None
    assert retention.purge(d, "2026-01-03", 1).count() == 3 and retention.purge(d, "2026-01-03", 0).count() == 0


def test_metrics(spark):
    d = spark.createDataFrame([("t", None, 10 * i, i < 6, None if i < 6 else "mcp_tool_failed") for i in range(1, 7)], metrics.CALLS_SCHEMA)
    r = metrics.report(d).where("level = 'overall'").collect()[0]
    assert (r["count"], r.error_count, r.error_rate, r.p50) == (6, 1, 16.67, 35.0)
    assert "t::default" in metrics.nested(d).collect()[0].report
    assert metrics.report(d.limit(0)).count() == 0 and metrics.error_maps(d).collect()[0].error_types == {"mcp_tool_failed": 1}


def test_limits_match_a_plain_fold(spark):
    times = [0, 1, 2, 59, 60, 61, 61.5, 62, 120, 121]
    d = spark.createDataFrame([(100 * u + i, u, float(t)) for u in (0, 1) for i, t in enumerate(times)], "event_id long, user_id long, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = {r.event_id: r.admitted for r in limits.limited(d, 3, 60.0).collect()}
    recent, want = [], []
    for t in times:
        recent = [x for x in recent if x > t - 60]
        want.append(len(recent) < 3)
        recent += [t] if want[-1] else []
    assert [got[i] for i in range(10)] == want == [got[100 + i] for i in range(10)] == limits.admit(times, deque(), 3, 60.0)


def test_obfuscation(spark):
    page = '<p class="k">Mail a.b@c.org or +1 (212) 555-0100</p><pre>keep me</pre><!-- c --><img alt="q" src="x.png" srcset=\'y.png 2x\'>'
    d = spark.createDataFrame([(page,), (None,)], "h string")
    out, none = (r[0] for r in d.select(obfuscate.obfuscate(F.col("h"))).collect())
    assert none is None and "a.b@c.org" not in out and "555" not in out and "<pre>keep me</pre>" in out and "<!-- c -->" in out and 'class="k"' in out and "x.png" not in out and "y.png" not in out
    assert obfuscate.scrub_pii_text("a@b.co, +1 (212) 555-0100") == "xxxxxx, +0 (000) 000-0000"


def test_lorem_is_a_fold():
    def slowly(length, seed):
        first = int(hashlib.md5(seed.encode()).hexdigest()[:8], 16) % len(obfuscate.LOREM)
        text, i = "", first
        while len(text) < length:
            word = obfuscate.LOREM[i % len(obfuscate.LOREM)]
            if len(text) + bool(text) + len(word) > length + 5:
                break
            text, i = f"{text} {word}".strip(), i + 1
        return text[:length].rstrip() if len(text) > length else text.ljust(length)

    assert all(obfuscate.lorem(n, f"s{k}") == slowly(n, f"s{k}") for n in range(60) for k in range(8))


def test_heading_of_a_section(spark):
    page = "<section><h2>A</h2><h1>B</h1><h1>C</h1></section><section><p>x</p></section><article><h3>D</h3></article>"
    d = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    assert [x.heading for x in html.structure(d, ("sections",)).first().structure.sections] == ["B", None, "D"]


def test_text(spark):
    value = lambda c: spark.range(1).select(c).collect()[0][0]
    assert value(text.slug(F.lit("https://www.a-b.com/x/"))) == "www_a_b_com_x" and value(text.slug(F.lit("https://"))) == "unknown"
    assert value(text.strip(F.lit("  a  "))) == "a"
    assert value(text.truncated(F.lit("One two. Three four"), F.lit(9))) == "One two.\n\n[Content truncated]"
    assert value(text.truncated(F.lit("short"), F.lit(9))) == "short"
    assert value(classify.error_code_of_class(F.lit("TemplateNotFoundError"))) == "TEMPLATE_NOT_FOUND"
    assert value(classify.duration_seconds(F.lit(" 1.5m "))) == 90.0 and value(classify.duration_seconds(F.lit("5 d"))) is None


def test_readers(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.html").write_text("<p>x</p>")
    (tmp_path / "s" / "b.txt").write_text("no")
    assert [r.html for r in readers.html_files(spark, str(tmp_path)).collect()] == ["<p>x</p>"]
    bad = spark.createDataFrame([('{"groups": {"a": {"count": -1}}}',)], "value string")
    with pytest.raises(Exception, match="invalid count"):
        readers.mix(bad).collect()
    assert readers.sites(spark.createDataFrame([("[]",), (None,)], "value string")).count() == 0


def test_selectors():
    from weftline.functions import dom

    root = dom.parse('<html><body><ul id="u"><li class="a b">1</li><li>2</li><li data-x="Foo">3<b></b></li></ul><h2>h</h2><p class=lead>x</p><p>y</p><div><p>z</p></div></body></html>')
    found = {
        "li:nth-child(2)": "2", "li:nth-child(odd)": "1 3", "li:nth-child(-n+2)": "1 2", "h2 + p": "x", "h2 ~ p": "x y", "ul > li:not(:first-child)": "2 3", "[data-x=foo i]": "3", "[data-x=foo]": "", "li:has(> b)": "3",
        "p:last-of-type": "y z", "ul, h2": "123 h", "body > p": "x y", "*:empty": "", "li:contains('2')": "2", ".a.b": "1", "#u li:last-child": "3", "p:is(.lead, div p)": "x z", "li:nth-last-child(1)": "3", "p:only-of-type": "z", "div:only-child": "",
    }
    for selector, want in found.items():
        assert " ".join(n.text() for n in dom.select(root, selector)) == want, selector
    for selector in ("li:nope", "li:nth-child(x)", "> li", "li >", "[a", "", "li,,p", "li:not(", "p:not()"):
        with pytest.raises(dom.SelectorError):
            dom.select(root, selector)


def test_obfuscation_of_broken_markup(spark):
    text = obfuscate.scrub_page_text("<pre><code>x</pre><p>secret words here</p><br><b>more &amp; more</b><script>if (a<b) keep</script> end <i")
    assert text.startswith("<pre><code>x</pre><p>") and "secret" not in text and "&amp;" in text and "<script>if (a<b) keep</script>" in text and len(text) <= len("<pre><code>x</pre><p>secret words here</p><br><b>more &amp; more</b><script>if (a<b) keep</script> end <i")
    assert "more" not in text
    for n in range(60):
        assert len(obfuscate.lorem(n, "s")) in (n, n - 1)


def test_crawl_of_equal_addresses(spark):
    """Pages without their end slash: the first address counts; spellings of one page use up places."""
    pages = spark.createDataFrame([("http://h/a/", ["http://h/b/", "http://h/b", "http://h/a", "http://h/c", "http://x/d"]), ("http://h/a", ["http://h/c"]), ("http://h/b/", ["http://h/c/"]), ("http://h/c", [])], "url string, links array<string>")
    seeds = spark.createDataFrame([(1, "http://h/a"), (2, "http://h/b")], "crawl_id int, start_url string")
    got = sorted((r.crawl_id, r.seq, r.depth, r.url) for r in crawl.crawl(seeds, pages, per_level=2).collect())
    assert got == [(1, 0, 1, "http://h/a"), (1, 1, 2, "http://h/c"), (2, 0, 1, "http://h/b/"), (2, 1, 2, "http://h/c")]


def test_retention_loop(spark, tmp_path):
    items = spark.createDataFrame([(f"g{i}", f"2026-01-0{i}", 10, None, True, "s") for i in range(1, 6)], "guid string, created_at string, size long, grp string, has_metadata boolean, scope string")
    gone = []
    spark.createDataFrame([(1,)], "tick long").write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("tick long").parquet(str(tmp_path / "ticks"))
    query = retention.keep_within(ticks, lambda: items, 25, lambda d: gone.extend(r.guid for r in d.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and sorted(gone) == ["g1", "g2", "g3"]


def test_settings_come_back(spark):
    from weftline import storage

    before = {k: spark.conf.get(k, None) for k in storage._WRITING}
    d = storage.materialize(spark.range(5), "t")
    assert d.count() == 5 and {k: spark.conf.get(k, None) for k in storage._WRITING} == before
    storage.discard(d)
    assert storage.fresh("a", spark.range(1).selectExpr("id AS A", "id AS a_")) == "a__"
