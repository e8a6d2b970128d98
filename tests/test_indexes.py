"""Prefix indexes of networks and paths against plain versions."""

import ipaddress
import random
import re

from weftline.operators import networks, robots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def longest(address, known):
    """By ipaddress: the longest network an address lies in, the first by text of equal ones."""
    try:
        ip = ipaddress.ip_address(address.strip())
    except (ValueError, AttributeError):
        return None
    found = [(-n.prefixlen, text) for text, n in known if n.version == ip.version and ip in n]
    return min(found)[1] if found else None


def test_longest_match(spark):
    r = random.Random(9)
    six = lambda: ":".join(f"{r.choice([0, 1, 0xfff0, 0x2001]):x}" for _ in range(8))
    four = lambda: ".".join(str(r.choice([0, 1, 10, 127, 128, 255])) for _ in range(4))
    nets = [f"{four()}/{r.randint(0, 32)}" for _ in range(300)] + [f"{six()}/{r.randint(0, 128)}" for _ in range(300)] + [four() for _ in range(20)] + [six() for _ in range(20)]
    nets += ["::ffff:10.0.0.0/104", "fe80::/10", " 10.1.0.0/16 "]
    known = [(x, ipaddress.ip_network(x.strip(), strict=False)) for x in nets]
    asked = [four() for _ in range(300)] + [six() for _ in range(300)] + ["::ffff:10.1.2.3", "fe80::1", "FE80::a", None, "", "x", "1.2.3", "1.2.3.400", "10.1.0.1", "10.1.0.1"]
    a = spark.createDataFrame([(i, x, "t") for i, x in enumerate(asked)], "id int, address string, text string")
    n = spark.createDataFrame([(x,) for x in [*nets, *nets[:9], None, "bad", "1.2.3.4/33", "::/129", "1.1.1.1/x"]], "network string")
    found = networks.longest_match(a, n)
    got = {r.id: r.matched for r in found.collect()}
    assert [got[i] for i in range(len(asked))] == [longest(x, known) for x in asked] and found.columns == ["id", "address", "text", "matched"]
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert sorted(r.id for r in networks.within(a, n).collect()) == [i for i in range(len(asked)) if got[i]]
    assert networks.within(a, n.limit(0)).count() == networks.longest_match(a.limit(0), n).count() == 0


def glob(path, rule):
    """Whether a rule matches, by a regular expression."""
    body = rule[:-1] if rule.endswith("$") else rule
    return re.match(".*".join(map(re.escape, re.split(r"\*+", body))) + ("$(?!\n)" if rule.endswith("$") else ""), path, re.S) is not None


def test_paths(spark):
    r = random.Random(12)
    some = lambda n: "".join(r.choice("ab/.*") for _ in range(r.randint(0, n)))
    rules = {f"h{h}": [("/" * r.randint(0, 1) + some(6) + r.choice(["", "", "$", "*$"]), r.random() < 0.5) for _ in range(25)] for h in range(6)}
    rules["h0"] += [("", False), ("/*/b$", True), ("/a*a*a", False), ("/é*", True)]
    body = lambda xs: "User-agent: *\nCrawl-delay: 3\n" + "\n".join(("Allow: " if a else "Disallow: ") + p for p, a in xs)
    bodies = spark.createDataFrame([(h, body(xs)) for h, xs in rules.items()], "host string, body string")
    paths = [(f"h{r.randint(0, 7)}", "/" + "".join(r.choice("ab/.é") for _ in range(r.randint(0, 8)))) for _ in range(600)]
    paths += [("h0", "/a"), ("h0", "/a"), (None, "/a")]
    d = spark.createDataFrame([(i, h, f"http://{h}{p}", "mine") for i, (h, p) in enumerate(paths)], "id int, host string, url string, path string")
    found = robots.check(d, robots.agent_groups(robots.groups(robots.parse(bodies)), "x"))
    assert found.columns == ["id", "host", "url", "path", "allowed", "crawl_delay"] and "NestedLoop" not in plan(found)
    got = {x.id: x for x in found.collect()}
    assert len(got) == len(paths)
    for i, (host, path) in enumerate(paths):
        hits = [(len(p.rstrip("*$")), a) for p, a in rules.get(host, []) if p and glob(path, p)]
        assert got[i].allowed == (max(hits)[1] if hits else True), (path, rules.get(host))
        assert got[i].crawl_delay == (3.0 if host in rules else None) and got[i].path == "mine"


def test_robots_blocks():
    agents = lambda body: [(g["agent"], g["crawl_delay"], [x["path"] for x in g["rules"]]) for g in robots.parse_body(body)["groups"]]
    assert agents("User-agent: Bo\nDisallow: /1\nUser-agent: Bot\nDisallow: /2\nUser-agent: Bo\nDisallow: /3") == [("Bo", None, ["/3"]), ("Bot", None, ["/2"])]
    assert agents("Crawl-delay: 4\nUser-agent: a\nUser-agent: b\nAllow: /") == [("a", 4.0, ["/"]), ("b", 4.0, ["/"])]
    assert agents("Disallow: /x\nCrawl-delay: 4\nUser-agent: a\nAllow: /") == [("a", None, ["/"])]
    assert agents("User-agent: a\nCrawl-delay: x\nCrawl-delay: 2 # s\nUser-agent: b\nAllow: /\nUser-agent: c\n") == [("a", 2.0, ["/"]), ("b", 2.0, ["/"])]
    assert agents(None) == [] and robots.parse_body("Sitemap: http://x/s.xml#f\nno colon")["sitemaps"] == ["http://x/s.xml"]


def test_repeated_agents(spark):
    body = "User-agent: Bo\nDisallow: /1\nUser-agent: Bot\nDisallow: /2\nUser-agent: Bo\nDisallow: /3"
    found = robots.agent_groups(robots.groups(robots.parse(spark.createDataFrame([("h", body)], "host string, body string"))), "botnet").first()
    assert found.agent == "Bo" and [x.path for x in found.rules] == ["/3"]
