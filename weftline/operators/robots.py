"""Robots rules: parsing, choice of the agent's group, longest match.

Bodies: host string, body string. Parsed: groups (host, agent, agent_seq, crawl_delay) and rules (host, agent, rule_seq,
path, allow).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import bound
from weftline.storage import fresh

_PARSED = "struct<groups:array<struct<agent:string,agent_seq:int,crawl_delay:double,rules:array<struct<rule_seq:int,path:string,allow:boolean>>>>,sitemaps:array<string>>"


def _lines(body: str) -> list[tuple[str, str]]:
    """(name, value) of the lines that have both, without comments."""
    pairs = (line.partition("#")[0].partition(":") for line in body.splitlines())
    return [(name.strip().lower(), value.strip()) for name, colon, value in pairs if colon]


def _blocks(lines: list[tuple[str, str]]) -> list[dict]:
    """Blocks of agents, rules and a delay: a block ends where an agent is named after rules. What stands before the first
    agent is a block without agents; a delay there, without rules, belongs to the first agents."""
    blocks = [{"agents": [], "rules": [], "delay": None}]
    for name, value in lines:
        if name == "user-agent":
            if blocks[-1]["rules"]:
                blocks.append({"agents": [], "rules": [], "delay": None})
            blocks[-1]["agents"].append(value)
        elif name in ("allow", "disallow"):
            blocks[-1]["rules"].append((value, name == "allow"))
        elif name == "crawl-delay":
            try:
                blocks[-1]["delay"] = float(value)
            except ValueError:
                pass
    return blocks


def parse_body(body: str | None) -> dict:
    """Groups in the order of their agents, with rules, and sitemaps.

    The agents of a block share its rules. A block without rules, at the end of the file, is dropped. A repeated agent has
    the rules of its last block, at the place of its first. Unreadable delays are ignored.
    """
    lines, by_agent = _lines(body or ""), {}
    for block in _blocks(lines):
        if block["rules"]:
            rules = [{"rule_seq": i, "path": path, "allow": allow} for i, (path, allow) in enumerate(block["rules"])]
            by_agent.update(dict.fromkeys(block["agents"], {"crawl_delay": block["delay"], "rules": rules}))
    return {"groups": [{"agent": a, "agent_seq": i, **g} for i, (a, g) in enumerate(by_agent.items())], "sitemaps": [v for name, v in lines if name == "sitemap"]}


def parse(bodies: DataFrame) -> DataFrame:
    """(host, parsed)."""

    @F.pandas_udf(_PARSED)
    def fn(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_body(b) for b in texts], columns=["groups", "sitemaps"])

    return bodies.select("host", fn("body").alias("parsed"))


def groups(parsed: DataFrame) -> DataFrame:
    return parsed.select("host", F.explode("parsed.groups").alias("g")).select("host", "g.agent", "g.agent_seq", "g.crawl_delay", "g.rules")


def sitemaps(parsed: DataFrame) -> DataFrame:
    return parsed.select("host", F.explode("parsed.sitemaps").alias("sitemap"))


def agent_groups(found: DataFrame, agent: str) -> DataFrame:
    """For each host the group for an agent: the exact name, else the first prefix in file order, else *."""
    name = F.lower("agent")
    wanted = F.lit(agent.lower())
    priority = F.when(name == wanted, 0).when((F.col("agent") != "*") & wanted.startswith(name), 1).when(F.col("agent") == "*", 2)
    best = Window.partitionBy("host").orderBy("priority", "agent_seq")
    return found.withColumn("priority", priority).where("priority IS NOT NULL").withColumn("turn", F.row_number().over(best)).where("turn = 1").drop("turn", "priority")


def match_path(url: Column) -> Column:
    """Path and query as rules see them."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def _matches(path: Column, rule: Column) -> Column:
    """Whether a path with the rule's literal beginning fits the rest of it: the pieces between stars are looked for one after
    the other, each as early as can be; with an end mark the last must be the path's end."""
    last = F.element_at(rule["pieces"], -1)
    # Where the path goes on behind the pieces so far, counted from 1; 0 if one of them isn't there.
    found = lambda at, piece: F.call_function("locate", piece, path, at)
    step = lambda at, piece: F.when(at == 0, 0).when(piece == "", at).otherwise(bound(found(at, piece), lambda x: F.when(x == 0, 0).otherwise(x + F.length(piece))))
    after = lambda pieces: F.aggregate(pieces, F.lit(rule["start"]), step)
    inner = F.slice(rule["pieces"], F.lit(1), F.greatest(F.size(rule["pieces"]) - 1, F.lit(0)))
    ends = bound(after(inner), lambda at: (at > 0) & path.endswith(last) & (F.length(path) - F.length(last) + 1 >= at))
    return F.when(~rule["anchored"], after(rule["pieces"]) > 0).when(F.size(rule["pieces"]) == 0, F.length(path) == rule["start"] - 1).otherwise(ends)


def indexed(chosen: DataFrame) -> DataFrame:
    """(host, prefix, rules) of the chosen groups' rules (a row for each host, rules as array): by the text before the first
    star or end mark. A rule has the pieces between its stars, whether it is anchored at the end, and its rank."""
    each = chosen.select("host", F.explode("rules").alias("r")).where(F.coalesce(F.col("r.path"), F.lit("")) != "").select("host", F.col("r.path").alias("path"), F.col("r.allow").alias("allow"))
    anchored = F.col("path").endswith("$")
    body = F.when(anchored, F.left("path", F.length("path") - 1)).otherwise(F.col("path"))
    parts = F.split(F.regexp_replace(body, r"\*+", "*"), r"\*")
    prefix = F.get(parts, F.lit(0))
    rule = F.struct(
        F.slice(parts, F.lit(2), F.size(parts)).alias("pieces"), (F.length(prefix) + 1).alias("start"), anchored.alias("anchored"),
        F.length(F.regexp_replace("path", r"[*$]+$", "")).alias("len"), F.col("allow"),
    )
    return each.select("host", prefix.alias("prefix"), rule.alias("rule")).groupBy("host", "prefix").agg(F.collect_set("rule").alias("rules"))


def check(urls: DataFrame, chosen: DataFrame) -> DataFrame:
    """urls (host, url) with ``allowed`` and ``crawl_delay`` by the chosen groups (a row for each host, rules as array).

    The longest matching rule decides, allowing on ties; without a match, a group or a file all is allowed. A path is cut
    to the lengths that the literal beginnings of its host's rules have, and the beginnings are joined by equality; only
    rules whose beginning is the path's are looked at further, piece by piece. Equal paths of a host are decided once.
    """
    columns = urls.columns
    path, own_host, own_path, allowed, host = (fresh(n, urls) for n in ("path", "own_host", "own_path", "rule_allows", "group_host"))
    index = indexed(chosen)
    lengths = index.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    d = urls.withColumn(path, match_path(F.col("url")))
    paths = d.select("host", F.col(path).alias("path")).distinct().join(lengths, "host")
    cut = paths.select("host", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).withColumn("prefix", F.left("path", F.col("n")))
    hit = F.transform(F.filter("rules", lambda r: _matches(F.col("path"), r)), lambda r: F.struct(r["len"].alias("len"), r["allow"].alias("allow")))
    best = cut.join(index, ["host", "prefix"]).groupBy("host", "path").agg(F.max(F.array_max(hit)).alias("best"))
    best = best.select(F.col("host").alias(own_host), F.col("path").alias(own_path), F.col("best.allow").alias(allowed))
    delays = chosen.select(F.col("host").alias(host), "crawl_delay")
    out = d.drop("allowed", "crawl_delay").join(best, (F.col("host") == F.col(own_host)) & (F.col(path) == F.col(own_path)), "left")
    out = out.join(delays, F.col("host") == F.col(host), "left")
    kept = [c for c in columns if c not in ("allowed", "crawl_delay")]
    return out.select(*kept, F.coalesce(allowed, F.lit(True)).alias("allowed"), "crawl_delay")
