"""Main text of pages, and exact top-k."""

import numpy as np
import pytest

from weftline.llm import html_text, topk

RICH = """<html><head><title>T</title></head><body class="x"><header class="site"><h1>Site</h1></header><main><article><header><h1>Big &amp; title</h1></header>
<p>One<br>two <a href="x>y">three</a>&nbsp;four<p>five<div class="share-bar">Share</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><section id="comments"><p>nope</section>
<script>if(a<b)"</p>"</script><div class="cookie-notice"><p>We use cookies</p></div><form><label>q</label></form></article><aside>no</aside></main><div>out</div><footer>f"""


def texts(spark, pages, **kw):
    d = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extract(d, **kw).collect()}


def test_article(spark):
    got = texts(spark, [("http://a/1", RICH), ("http://a/2", None), (None, ""), ("x", "<p>only</p>"), ("http://b/", "<article><p>a</p></article>"), ("http://b/", "<article><p>a</p></article>")])
    assert got[0] == "Big & title One two three four five a b c d"
    assert (got[1], got[2], got[3], got[4], got[5]) == ("", "", "only", "a", "a")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article>a &lt;b&gt; &#233;&#x41; &amp", "a <b> éA &"), ("<article><p>a <b>b</b>c\n d</p>\t<p> </p>e</article>", "a bc d e"), ("<article><p>cut <a href=\"", "cut"), ("no markup & more", "no markup & more"),
        ("<article><p>x</p><!-- <p>y</p> --></article>z", "x"), ("<article><h1>h</h1><p>p</article><nav>n</nav>", "h p"), ("<ARTICLE><P CLASS=Ad>no<P>yes</ARTICLE>", "yes"), ("<article></article>", ""),
    ],
)
def test_parsing(spark, page, text):
    assert texts(spark, [("http://h/", page)])[0] == text


def test_hosts_tell_boilerplate(spark):
    line = "subscribe to our daily letter and never miss a story again"
    pages = [(f"http://h/{i}", f"<div>{line}</div><div>word{i} is only said on page {i} here</div><div>Read on</div>") for i in range(150)]
    pages += [("http://other/", f"<div>{line}</div>")]
    got = texts(spark, pages)
    assert all(got[i] == f"word{i} is only said on page {i} here" for i in range(150))
    assert got[150] == line  # another host's
    # A paragraph of an article stays, however often it recurs; a loose block in it goes.
    got = texts(spark, [(f"http://h/{i}", f"<article><p>{line}</p><div>{line} now</div><div>own {i}</div></article>") for i in range(5)])
    assert all(got[i] == f"{line} own {i}" for i in range(5))


def test_boilerplate_on_part_of_a_large_host(spark):
    line = "the spring sale of garden chairs ends on the last day of may"
    own = [f"<div>page {i} tells a story of its own about {i} things</div><div>more {i}</div>" for i in range(320)]
    pages = [(f"http://h/{i}", own[i] + (f"<div>{line}</div><div>Read on</div>" if i % 32 == 0 else "")) for i in range(320)]
    got = texts(spark, pages)
    assert all(got[i] == f"page {i} tells a story of its own about {i} things more {i}" for i in range(320))
    assert got == texts(spark, pages, shard_pages=1000)
    # On two pages of the host it is no boilerplate, in whatever shards they are.
    got = texts(spark, [(u, h if i in (32, 288) else own[i]) for i, (u, h) in enumerate(pages)], shard_pages=8)
    assert all(got[i].endswith(f"{line} Read on") == (i in (32, 288)) for i in range(320))


def test_names_are_a_prior(spark):
    """What a part of a class name hints at is decided by the host's pages, both ways."""
    line = "the spring sale of garden chairs ends on the last day of may"
    own = lambda i: f"a text of its own about {i} things that are on page {i} and nowhere else"
    wrap = {"share-header": "<article><p>t{0}</p><div class='share-header'>{1}</div></article>", "notice-period": "<article><p>t{0}</p><p class='notice-period'>{1}</p></article>",
            "related-work": "<article><p>t{0}</p><section class='related-work'><p>{1}</p></section></article>", "header-note": "<div id='content'><p>t{0}</p><div class='header-note'>{1}</div></div>"}
    pages = [(f"http://{k}.{kind}/{i}", x.format(i, own(i) if kind == "own" else line)) for k, x in wrap.items() for kind in ("own", "same") for i in range(8)]
    got = texts(spark, pages)
    for i, (url, _) in enumerate(pages):
        n = int(url.rsplit("/", 1)[1])
        assert got[i] == (f"t{n} {own(n)}" if ".own/" in url else f"t{n}"), url
    # With a page or two there is nothing to go by: a name that is made of cues goes, one that has a cue in it stays.
    few = texts(spark, [(f"http://{k}/1", x.format(0, own(0))) for k, x in wrap.items()])
    assert [few[i] for i in range(4)] == ["t0", *[f"t0 {own(0)}"] * 3]
    # A name that is a cue goes.
    assert set(texts(spark, [(f"http://h/{i}", f"<article><p>t</p><div class='x ad'>{own(i)}</div></article>") for i in range(8)]).values()) == {"t"}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p class=it's>Hello one</p><p>World isn't here</p><p>end</p></article>", "Hello one World isn't here end"), ("<article><p title='a > b' \">x</p></article>", "x"),
        ("<article><a title=\"x>y\" href=it's>l</a> m</article>", "l m"), ("<article><p a = 'b>c'>x</p></article>", "x"),
    ],
)
def test_quotes_count_behind_an_equals_sign(spark, page, text):
    assert texts(spark, [("http://h/", page)])[0] == text


def test_odd_markup_takes_linear_time():
    import time

    n = 140_000  # about a megabyte each
    for page in ("<b>" * n + "</i>" * n, "<div><p>x" * (n // 2), "<li><ul>" + "<b>" * n + "<li>x</li>" * (n // 3), "<td>" * n + "</p>" * n, "<p class=a'b>" * (n // 2)):
        began = time.time()
        html_text.blocks(page)
        assert time.time() - began < 15


def test_equal_pages_count_once(spark):
    assert texts(spark, [("http://h/1", "<p>text</p>"), ("http://h/1", "<p>text</p>")]) == {0: "text", 1: "text"}
    story = "<p>the only copy of this long story was told here in many words</p>"
    pages = [(f"{scheme}://h/story?{i}", f"<!-- {i} -->{story}<p>Menu</p>") for i, scheme in enumerate(["http", "https", "http", "http"])]
    pages += [(f"http://h/{i}", f"<p>other words {i}</p><p>Menu</p>") for i in range(80)]
    for shard_pages in (4, 64):
        got = texts(spark, pages, shard_pages=shard_pages)
        assert all(got[i] == story[3:-4] for i in range(4)) and all(got[4 + i] == f"other words {i}" for i in range(80))


def test_run_counts():
    rng = np.random.default_rng(3)
    pages = [[[str(x) for x in rng.integers(0, 2, rng.integers(1, 9))] for _ in range(3)] for _ in range(12)]
    want, told = {}, html_text.Pages([html_text.pack([(b, 0) for b in p], 4) for p in pages], 4)
    for page, found in enumerate(pages):
        for words in map(tuple, found):
            for run in [words] if len(words) < 4 else [words[i : i + 4] for i in range(len(words) - 3)]:
                want.setdefault(run, set()).add(page)
    runs, counts = told.counts()
    assert sorted(counts.tolist()) == sorted(map(len, want.values())) and len(set(runs.tolist())) == len(want)
    often = runs[counts >= 9]
    mask, at = told.covered(often), 0
    for found in pages:
        for words in map(tuple, found):
            hit = [False] * len(words)
            for i in range(max(len(words) - 3, 1)):
                if len(want[words[i : i + 4]]) >= 9:
                    hit[i : i + 4] = [True] * len(words[i : i + 4])
            assert mask[at : at + len(words)].tolist() == hit
            at += len(words)


def brute_pages(pages, min_tokens=8, min_pages=3, common_pages=5):
    """The decisions page by page, with sets instead of suffix arrays, shards and hashes."""
    parsed = [(u.split("/")[2], html_text.blocks(h)) for u, h in pages]
    runs_of = lambda t: [t.split()] if len(t.split()) < min_tokens else [t.split()[i : i + min_tokens] for i in range(len(t.split()) - min_tokens + 1)]
    out = []
    for host, found in parsed:
        mine = {tuple(b) for h, b in parsed if h == host}
        on = {}
        for b in mine:
            for run in {tuple(r) for t, _ in b for r in runs_of(t)}:
                on[run] = on.get(run, 0) + 1
        least, half = max(2, min(min_pages, len(mine))), max(common_pages, -(-len(mine) // 2))

        def mask(t, n):
            words = t.split()
            hit = [False] * len(words)
            for i, r in enumerate(runs_of(t)):
                if on[tuple(r)] >= n:
                    hit[i : i + len(r)] = [True] * len(r)
            return hit

        main = [i for i, (_, k) in enumerate(found) if k == html_text.MAIN]
        gone = {i for i in main if np.mean(mask(found[i][0], half)) >= 0.8}
        size = lambda xs: sum(len(found[i][0].split()) for i in xs)
        gone = set() if 2 * size(gone) >= size(main) else gone
        kept = []
        for i, (t, k) in enumerate(found):
            hit = mask(t, least)
            if k == html_text.NAMED and len(mine) >= common_pages and np.mean(hit) < 0.8 or k == html_text.MAIN and i not in gone or k == html_text.LOOSE and main and np.mean(hit) < 0.8:
                kept.append(t)
            elif k == html_text.LOOSE and not main and (stay := " ".join(w for w, h in zip(t.split(), hit) if not h)):
                kept.append(stay)
        out.append(" ".join(kept))
    return out


@pytest.mark.parametrize("shard_pages", [4, 64])
def test_hosts_decide_as_by_brute_force(spark, shard_pages):
    import random

    r = random.Random(shard_pages)
    say = lambda n: " ".join(r.choice("abcdefghijklmnop") + r.choice("qrstuvwxyz") for _ in range(n))
    notes = [say(n) for n in (3, 9, 14, 30)]
    pages = []
    for i in range(90):
        host = r.choice(["one", "one", "two", "three"])
        inner = "".join(f"<p>{say(r.randint(2, 40))}</p>" + (f"<p>{notes[1]}</p>" if host == "one" and r.random() < 0.8 else "") + (f"<div>{r.choice(notes)}</div>" if host == "two" else "") for _ in range(2))
        body = f"<article>{inner}</article>" if host != "three" else f"<div>{say(12)} {r.choice(notes)} {say(3)}</div><div>{notes[0]}</div>"
        pages.append((f"http://{host}/{i}", f"<nav>{notes[2]}</nav>{body}<footer>{notes[3]}</footer>"))
    # Names that hint at chrome, on hosts of many and of few pages.
    for i in range(40):
        host, name = r.choice([("four", "share-header"), ("four", "cookie-note"), ("four", "share-bar"), (f"few{i % 9}", "share-header")])
        note = r.choice([notes[1], say(20), say(4), notes[0]])
        pages.append((f"http://{host}/{i}", f"<article><p>{say(30)}</p><div class='{name}'>{note}</div><p class=promo-code>{r.choice(notes)}</p></article>"))
    pages += pages[:6]
    got = texts(spark, pages, shard_pages=shard_pages)
    assert [got[i] for i in range(len(pages))] == brute_pages(pages)
    had = [i for i, (u, h) in enumerate(pages) if "//one/" in u and f"<p>{notes[1]}</p>" in h]
    assert sum(notes[1] in got[i] for i in had) < 0.5 * len(had)  # but for articles of which it is half or more


def test_suffix_ranks():
    rng = np.random.default_rng(0)
    for depth in (1, 2, 3, 5, 8):
        tokens = rng.integers(0, 3, 200)
        order, rank = html_text.suffix_ranks(tokens, depth)
        starts = [tuple(tokens[i : i + depth]) for i in range(200)]
        assert [starts[i] for i in order] == sorted(starts)
        assert all((rank[i] == rank[j]) == (starts[i] == starts[j]) for i in range(0, 200, 7) for j in range(200))


def test_page_cases(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.report(d).count() == 0
    d = spark.createDataFrame([(None, "http://h/", "<p>é</p>", "x", "y")], "page_id long, url string, html string, text string, key string")
    assert [tuple(r) for r in html_text.report(d).collect()] == [(None, "http://h/", "é", 1)]


def brute_topk(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ v), i) for i, v in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("block_rows", [7, 256])
@pytest.mark.parametrize("query_bytes", [1 << 24, 100])
def test_topk(spark, block_rows, query_bytes):
    rng = np.random.default_rng(block_rows)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(40)]
    rows += [(2000, None), (2001, [1.0, None]), (2050, [float("nan")] * 6), (2051, [float("inf")] * 6), (None, [1.0] * 6), (2100, [9.0]), (2101, [])]
    d = spark.createDataFrame(rows, VECTORS).repartition(3)
    from pyspark.sql import functions as F

    got = topk.search(d, d.where(F.col("vec_id") % 50 == 0), block_rows=block_rows, query_bytes=query_bytes)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows)


def test_topk_prunes_and_cases(spark):
    rng = np.random.default_rng(1)
    search = topk.Search(np.arange(4), rng.integers(1, 9, (4, 8)), 2)
    blocks = [(np.arange(100 * b, 100 * b + 100), rng.integers(0, 5, (100, 8)) * (50 if b == 3 else 1)) for b in range(20)]
    search.add(blocks)
    assert search.scored < 4 * 2000 / 4
    assert topk.report(spark.createDataFrame([], VECTORS)).count() == 0
    assert topk.report(spark.createDataFrame([(0, [1.0]), (50, [2.0])], VECTORS)).count() == 2
    assert topk.report(spark.createDataFrame([(1, [1.0])], VECTORS)).count() == 0
    big = spark.createDataFrame([(0, [3e5] * 4), (1, [-3e5] * 4), (2, [2e5] * 4)], VECTORS)
    assert [(r.vec_id, r.score) for r in topk.report(big).collect()] == [(2, 4 * 76800000 * 51200000), (1, -4 * 76800000 * 76800000)]


def test_topk_of_large_numbers(spark):
    """Whole numbers all along: scores beyond 2^53 differ in their last place; beyond 64 bits is an error."""
    big = [(0, [float(2**22), 1 / 256.0]), (1, [float(2**22), 0.0]), (2, [float(2**22), 1 / 256.0]), (50, [1.0, 1.0])]
    d = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(d, d.where("vec_id = 0"), k=2).collect()]
    assert sorted(got) == [(0, 1, 2, 2**60 + 1), (0, 2, 1, 2**60)]
    rng = np.random.default_rng(2)
    ids, m = np.arange(300), rng.integers(-(2**28), 2**28, (300, 4))
    search = topk.Search(ids[::50], m[::50], 5)
    search.add([(ids[a : a + 20], m[a : a + 20]) for a in range(0, 300, 20)])
    want = [sorted((-int(sum(int(a) * int(b) for a, b in zip(m[q], m[i]))), int(i)) for i in ids if i != q)[:5] for q in ids[::50]]
    assert [[(-int(s), int(i)) for s, i in zip(search.score[n], search.best[n])] for n in range(6)] == want
    with pytest.raises(OverflowError):
        search.add([(np.array([1]), np.full((1, 4), 2**40))])
