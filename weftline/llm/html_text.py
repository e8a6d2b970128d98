"""Main text of web pages, with boilerplate found by suffix arrays over the pages of a host.

A page is parsed into blocks, and its markup gives each a prior: CHROME in menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments; MAIN for paragraphs, headings, lists and tables of an article; LOOSE for
what is between. NAMED is what only a part of a class name makes look like chrome, such as "share-header" inside an article; if
other parts of the name say nothing, as in "notice-period", the block is LOOSE. The host decides: the token streams of its pages, all blocks, are concatenated, a suffix array groups
equal substrings of ``min_tokens`` tokens (or whole blocks of fewer), and the distinct pages that have each are counted.

* LOOSE blocks lose what is on ``min_pages`` pages; inside an article a block goes as a whole if it is mostly covered.
* MAIN blocks go if they are mostly covered by substrings that half of the host's pages have (``common_pages`` at
  least): notices that a site writes into every article. If that would take half of an article or more, the article
  is one that recurs, e.g. copied pages, and it stays.
* NAMED blocks go if they are mostly covered by what ``min_pages`` pages have, and where a host has fewer than
  ``common_pages`` pages to go by; on a larger host a block that is on its page only stays.
* CHROME blocks go; they count as witnesses of what the host repeats.

A large host is dealt into shards of about ``shard_pages`` distinct pages, so that no task gets a whole large host, and
counts are those of the whole host: what half of the pages have, half of some shard's pages have, so every shard names
its candidates and all shards count them; where a host has LOOSE blocks, all substrings are counted in all shards.

Defined cases: null or empty html gives an empty text; an empty table gives an empty result; a null or odd url counts as
one host of that spelling; pages of a host with equal blocks count as one page, whatever their rows; other columns are
ignored; unclosed and truncated markup is closed at the end; pages may be of any length; words are told apart by 24 bits
of hash in substrings, short blocks by 48 bits, and substrings by 64 when shards' counts are added.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bitmap_rows, join_hot, map_arrow, marked, mix, window_hashes
from weftline.storage import discard, materialize

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|$)|'[^']*(?:'|$))?)*)(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CUE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_RAW = frozenset("script style noscript template iframe textarea title xmp svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form button select option datalist head object canvas audio video dialog menu map".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SETTLED = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption caption summary address".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "head"}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar note".split())
_CUES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promotions banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login comment comments disqus commentlist respond reply replies pagination pager toolbar copyright".split()
)

#: Names of containers of the text, and pairs of words of which such names are made.
_CONTENT = frozenset("content main article post story entry articlebody".split())
_CONTENT_OF, _CONTENT_PART = frozenset("article post story entry main page".split()), frozenset("body content text".split())

#: Words that say nothing beside a cue in a name.
_BESIDE = frozenset("area bar block bottom box button buttons container group inner item items left link links list main outer page panel post right row section site top wrap wrapper".split())

MAIN, LOOSE, CHROME, NAMED = 0, 1, 2, 3


def _hint(names: list[str]) -> int:
    """What class names and ids say: 3 chrome, if one is a cue; 2 if one is made of cues; 1 if one has a cue in it; 0 nothing."""
    parts = [{w.lower() for w in _CUE_WORD.findall(n)} for n in names]
    if any(n.lower() in _CUES for n in names):
        return 3
    return 2 if any(p & _CUES and p <= _CUES | _BESIDE for p in parts) else 1 if any(p & _CUES for p in parts) else 0


def _holds_text(cues: set[str], names: list[str]) -> bool:
    return any(n.lower() in _CONTENT for n in names) or bool(cues & _CONTENT_OF and cues & _CONTENT_PART)


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, MAIN | LOOSE | CHROME | NAMED) of all non-empty blocks, in page order."""
    found: list[list] = []  # text, is chrome, block tag, region, hint
    stack: list[tuple[str, int, int, str, int]] = []  # tag, chrome (0 no, 1 but for headings, 2 yes), region (0, 1 main, 2 article), block tag, hint
    open_: dict[str, list[int]] = {}  # places on the stack, by tag
    pieces: list[str] = []
    nowhere = state = ("", 0, 0, "", 0)

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            _, chrome, region, block, hint = state
            found.append([text, chrome == 2 or chrome == 1 and block not in _HEADINGS, block, region, hint])

    def pop_to(tag: str, fence: frozenset = frozenset()) -> None:
        nonlocal state
        at = open_[tag][-1] if open_.get(tag) else -1
        if at < 0 or any(open_[x][-1] > at for x in fence if open_.get(x)):
            return
        if any(x[0] in _BLOCK for x in stack[at:]):
            flush()
        for x in stack[at:]:
            open_[x[0]].pop()
        del stack[at:]
        state = stack[-1] if stack else nowhere

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            pieces.append(_html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br" or tag == "p" and not open_.get("p"):
                pieces.append(" ")
            else:
                pop_to(tag)
            continue
        if tag in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            pieces.append(" " if tag in ("textarea", "iframe") else "")
            continue
        if tag in _BLOCK:
            if tag in _CLOSES_P:
                pop_to("p", frozenset(("td", "th", "li", "div", "article", "section", "button", "body")))
            elif tag == "li":
                pop_to("li", frozenset(("ul", "ol", "menu")))
            elif tag in ("td", "th", "tr"):
                pop_to(tag, frozenset(("table",)))
            elif tag in ("dd", "dt"):
                pop_to("dd", frozenset(("dl",)))
                pop_to("dt", frozenset(("dl",)))
            flush()
        if tag in _VOID:
            if tag in ("br", "hr"):
                pieces.append(" ")
            continue
        if m[3].endswith("/") and tag not in _BLOCK:
            continue
        _, chrome, region, block, hint = state
        if tag == "article":
            region = 2
        elif tag == "main":
            region = max(region, 1)
        cues, role, names = set(), "", []
        if m[3]:
            for name, a, b, c in _ATTRIBUTE.findall(m[3]):
                value = a or b or c
                if name.lower() == "role":
                    role = value.strip().lower()
                else:
                    names += value.split()
                    cues.update(w.lower() for w in _CUE_WORD.findall(value))
        if role == "main" or names and tag in ("div", "section", "td") and _holds_text(cues, names):
            region = max(region, 1)
        if tag not in ("html", "body", "article", "main"):
            said = _hint(names)
            if tag == "header" or said == 3 and cues & _CUES == {"header"} or role == "banner":
                chrome = max(chrome, 1 if region == 2 else 2)
            elif tag in _DROPPED or said == 3 or role in _ROLES:
                chrome = 2
            hint = max(hint, said)
        elif tag == "article" and cues & {"comment", "comments", "teaser", "reply"}:
            chrome = 2
        state = (tag, chrome, region, tag if tag in _BLOCK else block, hint)
        open_.setdefault(tag, []).append(len(stack))
        stack.append(state)
    if at < len(page):
        pieces.append(_html.unescape(page[at:]))
    flush()
    best = max((region for _, chrome, _, region, _ in found if not chrome), default=0)
    out = []
    for text, chrome, block, region, hint in found:
        if chrome or region < best or hint == 2 and not best:  # without a container, names are all there is
            out.append((text, CHROME))
        elif hint:
            out.append((text, NAMED if hint == 2 else LOOSE))
        else:
            out.append((text, MAIN if best and block in _SETTLED else LOOSE))
    return out


_STREAMS = "host string, content binary, open boolean, stream binary"


def _digest(found: list[tuple[str, int]]) -> bytes:
    return hashlib.blake2b(repr(found).encode("utf-8", "replace"), digest_size=16).digest()


def _whole(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=6).digest()


def pack(found: list[tuple[list[str], int]], min_tokens: int) -> bytes:
    """A page's blocks (words, kind) as its token stream: their number, the size and kind of each, digests of 48 bits of
    those that are shorter than a run, and 24 bits of hash for each word of the others."""
    shape = np.array([len(found), *[len(w) * 4 + k for w, k in found]], "<u4")
    short = [_whole(w) for w, _ in found if 0 < len(w) < min_tokens]
    words = np.array([zlib.crc32(x.encode("utf-8", "replace")) for w, _ in found if len(w) >= min_tokens for x in w], "<u4")
    return b"".join([shape.tobytes(), *short, words.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()])


def unpack(data: bytes, min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape, digests, tokens) of a stream."""
    n = int.from_bytes(data[:4], "little")
    shape = np.frombuffer(data, "<u4", n, 4).astype(np.int64)
    size = shape >> 2
    at = 4 + 4 * n
    short = int(((size > 0) & (size < min_tokens)).sum())
    digests, tokens = np.zeros((short, 8), np.uint8), np.zeros((int(size[size >= min_tokens].sum()), 4), np.uint8)
    digests[:, :6] = np.frombuffer(data, np.uint8, 6 * short, at).reshape(-1, 6)
    tokens[:, :3] = np.frombuffer(data, np.uint8, 3 * len(tokens), at + 6 * short).reshape(-1, 3)
    return shape, digests.view("<u8").ravel(), tokens.view("<u4").ravel().astype(np.int64)


def _streams(min_tokens: int):
    """The token stream of each page, and whether it has LOOSE or NAMED blocks."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, open_, streams = [], [], []
        for page in batch.column("html").to_pylist():
            found = blocks(page or "")
            content.append(_digest(found))
            open_.append(any(k in (LOOSE, NAMED) for _, k in found))
            streams.append(pack([(t.split(), k) for t, k in found], min_tokens))
        made = [pa.array(content, pa.binary()), pa.array(open_, pa.bool_()), pa.array(streams, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("host"), *made], names=["host", "content", "open", "stream"])

    return fn


def suffix_ranks(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``tokens`` by their first ``depth`` tokens, and the rank of each suffix; equal ranks mean
    equal beginnings. By doubling: ranks of 2^k tokens from pairs of ranks of 2^(k-1), the last step overlapping."""
    _, rank = np.unique(tokens, return_inverse=True)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        following = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), rank.dtype)])[: len(rank)]
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 2) + following, return_inverse=True)
        have += step
    return np.argsort(rank, kind="stable"), rank


class Pages:
    """The concatenated token streams of some pages, with the runs in them: substrings of ``min_tokens`` tokens of a
    block, and whole blocks of fewer."""

    def __init__(self, streams: list[bytes], min_tokens: int):
        self.min_tokens, self.n = min_tokens, len(streams)
        parts = [unpack(x, min_tokens) for x in streams]
        shape, short, tokens = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        self.kinds, self.sizes = shape & 3, shape >> 2
        self.ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in parts])]).astype(np.int64)
        self.page_of_block = np.repeat(np.arange(self.n), np.diff(self.ends))
        # Words of short blocks are told by the digests alone.
        self.tokens = np.zeros(int(self.sizes.sum()), np.int64)
        self.tokens[np.repeat(self.sizes >= min_tokens, self.sizes)] = tokens
        self.starts = np.cumsum(self.sizes) - self.sizes
        hashes = window_hashes(mix(self.tokens.view(np.uint64)), min_tokens)
        # Places where a run begins: all of a block but its last min_tokens - 1; the first of a short block.
        length = np.maximum(self.sizes - min_tokens + 1, (self.sizes > 0).astype(np.int64))
        self.block = np.repeat(np.arange(len(self.sizes)), length)
        self.place = np.arange(len(self.block)) - np.repeat(np.cumsum(length) - length, length)
        at = self.starts[self.block] + self.place
        self.run = np.zeros(len(at), np.uint64)
        long = self.sizes[self.block] >= min_tokens
        self.run[long] = hashes[at[long]] if len(hashes) else 0
        self.run[~long] = short
        self.run = self.run.view(np.int64)
        self.at, self.long = at, long

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs, and how many of the pages have each."""
        # Every block ends with a separator that equals nothing, so that equal suffixes lie in their blocks.
        stream = np.insert(self.tokens, self.starts + self.sizes, np.arange(len(self.sizes)) + (1 << 40)) if len(self.sizes) else self.tokens
        _, rank = suffix_ranks(stream, self.min_tokens)
        group = rank[self.at + self.block].astype(np.int64)
        # A short block is told by its hash: its suffixes end in its own separator.
        _, short = np.unique(self.run[~self.long], return_inverse=True)
        group[~self.long] = short + len(stream) + 1
        order = np.lexsort((self.page_of_block[self.block], group)) if len(group) else np.zeros(0, np.int64)
        group, page = group[order], self.page_of_block[self.block][order]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        other = new.copy()
        other[1:] |= page[1:] != page[:-1]
        first = np.flatnonzero(new)
        return self.run[order[first]], np.add.reduceat(other.astype(np.int64), first) if len(first) else first

    def covered(self, often: np.ndarray) -> np.ndarray:
        """Which tokens lie in a run that is one of ``often``."""
        hit = np.isin(self.run, often)
        change = np.zeros(len(self.tokens) + 1, np.int64)
        size = np.minimum(self.sizes[self.block], self.min_tokens)
        np.add.at(change, self.at[hit], 1)
        np.add.at(change, (self.at + size)[hit], -1)
        return np.cumsum(change)[:-1] > 0

    @classmethod
    def of(cls, group: pd.DataFrame, min_tokens: int) -> Pages:
        return cls([*group["stream"]], min_tokens)


#: What holds for a host goes along with its rows, so that nothing is joined by host.
_HOST = ["loose", "shards", "least", "half", "n"]
_COUNTS = "host string, shard long, run long, pages long, loose boolean, shards long, least long, half long, n long"


def _rows(group: pd.DataFrame, runs: np.ndarray, pages: np.ndarray) -> pd.DataFrame:
    first, n = group.iloc[0], len(runs)
    same = lambda c: pd.Series([first[c]] * n, dtype=object if c == "host" else bool if c == "loose" else np.int64)
    return pd.DataFrame({"host": same("host"), "shard": same("shard"), "run": runs, "pages": pages.astype(np.int64), **{c: same(c) for c in _HOST}})


def _count(min_tokens: int):
    """Counts of a shard's pages: of all runs where the host has loose blocks, else of those that half of the pages have."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        runs, pages = Pages.of(group, min_tokens).counts()
        keep = (pages > 1) & (2 * pages >= len(group)) if not group["loose"].iloc[0] else pages > 0
        return _rows(group, runs[keep], pages[keep])

    return run


def _count_asked(min_tokens: int):
    def run(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(asked):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ["host", "shard", "run", "pages", *_HOST]})
        runs, pages = Pages.of(group, min_tokens).counts()
        keep = np.isin(runs, asked["run"].to_numpy())
        return _rows(group, runs[keep], pages[keep])

    return run


def _decide(min_tokens: int, common_pages: int, share: float = 0.8):
    """What the blocks of each page lose, flat: block, number of places, and the places between which tokens stay."""

    def run(group: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        contents, cuts = [], []
        if len(group):
            pages = Pages.of(group, min_tokens)
            told, all_ = runs["run"].to_numpy(np.int64), runs["common"].to_numpy(bool)
            often, common = pages.covered(told), pages.covered(told[all_])
            part = lambda mask, b: mask[pages.starts[b] : pages.starts[b] + pages.sizes[b]]
            for page, (a, z) in enumerate(zip(pages.ends[:-1].tolist(), pages.ends[1:].tolist(), strict=True)):
                main = [b for b in range(a, z) if pages.kinds[b] == MAIN]
                gone = [b for b in main if part(common, b).mean() >= share]
                if 2 * sum(pages.sizes[gone]) >= sum(pages.sizes[main]):
                    gone = []
                cut = [x for b in gone for x in (b - a, 0)]
                few = group["n"].iloc[0] < common_pages
                cut += [x for b in range(a, z) if pages.kinds[b] == NAMED and (few or part(often, b).mean() >= share) for x in (b - a, 0)]
                for b in [b for b in range(a, z) if pages.kinds[b] == LOOSE]:
                    mask = part(often, b)
                    if main and mask.mean() >= share:
                        cut += [b - a, 0]
                    elif not main and mask.any():
                        edges = np.flatnonzero(np.diff(np.concatenate([[1], mask.astype(int), [1]])))
                        cut += [b - a, len(edges), *edges.tolist()]
                if cut:
                    contents.append(group["content"].iloc[page])
                    cuts.append(cut)
        return pd.DataFrame({"host": pd.Series([group["host"].iloc[0] if len(group) else None] * len(contents), dtype=object), "content": pd.Series(contents, dtype=object), "cuts": pd.Series(cuts, dtype=object)})

    return run


_CUTS = "array<int>"


def _text(found: list[tuple[str, int]], cuts: list[int] | None) -> str:
    lost, kept, at = {}, [], 0
    while cuts and at < len(cuts):
        lost[cuts[at]] = cuts[at + 2 : at + 2 + cuts[at + 1]]
        at += 2 + cuts[at + 1]
    for i, (text, kind) in enumerate(found):
        if kind == CHROME:
            continue
        if i in lost:
            words, stay = text.split(), lost[i]
            kept += [" ".join(words[a:b]) for a, b in zip(stay[::2], stay[1::2], strict=True)]
        else:
            kept.append(text)
    return " ".join(kept)


def decisions(pages: DataFrame, min_tokens: int = 8, min_pages: int = 3, common_pages: int = 5, shard_pages: int = 64) -> DataFrame:
    """(host, key, cuts) of the pages that lose something of their MAIN or LOOSE blocks. pages: host, key, html; pages with
    equal keys have equal html."""
    streams = map_arrow(pages.select("host", "html"), _streams(min_tokens), _STREAMS, 256)
    # Equal pages are one; of a page that a third of all rows are, one row of each task is left before they move.
    distinct = materialize(streams.groupBy("host", "content").agg(F.first("open").alias("open"), F.first("stream").alias("stream")), "page-streams")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("n"), F.max("open").alias("loose"))
    # With fewer distinct pages than asked for, all of them must have a run.
    hosts = hosts.select("host", F.col("n").cast("long").alias("n"), "loose", F.ceil(F.col("n") / shard_pages).alias("shards"), F.greatest(F.lit(2), F.least(F.lit(min_pages), F.col("n"))).cast("long").alias("least"), F.greatest(F.lit(common_pages), F.ceil(F.col("n") / 2)).cast("long").alias("half"))
    hosts = materialize(hosts, "page-hosts")
    # Named apart from the count that join_hot goes by.
    deal = lambda d: d.withColumnRenamed("pages_n", "n").select("host", F.pmod(F.xxhash64("content"), "shards").alias("shard"), "content", "stream", *_HOST)
    dealt = join_hot(distinct, hosts.withColumn("pages_n", F.col("n")), ["host"], deal)
    counts = materialize(dealt.groupBy("host", "shard").applyInPandas(_count(min_tokens), _COUNTS), "page-runs")
    # Candidates of hosts of several shards, unless all their runs are counted anyway.
    large = F.expr("shards > 1 and not loose")
    asked = counts.where(large)
    final = counts.where(~large)
    if not asked.isEmpty():
        asked = asked.select("host", "run", "shards").distinct().select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "run")
        again = dealt.where(large).groupBy("host", "shard").cogroup(asked.groupBy("host", "shard")).applyInPandas(_count_asked(min_tokens), _COUNTS)
        final = materialize(final.unionByName(again), "page-runs")
    totals = final.groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.min("least").alias("least"), F.min("half").alias("half")).where("pages >= least")
    totals = materialize(totals.select("host", "run", (F.col("pages") >= F.col("half")).alias("common")), "page-totals")
    # Only shards that have something that is often on the host, or blocks for the host to decide on, decide anything.
    told = materialize(final.select("host", "shard", "run").join(totals, ["host", "run"]), "page-told")
    some = dealt.where("loose").unionByName(dealt.where("not loose").join(told.select("host", "shard").distinct(), ["host", "shard"], "left_semi"))
    decided = some.groupBy("host", "shard").cogroup(told.groupBy("host", "shard")).applyInPandas(_decide(min_tokens, common_pages), f"host string, content binary, cuts {_CUTS}")
    cuts = materialize(decided if not (told.isEmpty() and hosts.where("loose").isEmpty()) else distinct.limit(0).select("host", "content", F.array().cast(_CUTS).alias("cuts")), "page-cuts")
    discard(distinct, hosts, counts, totals, told)
    if cuts.isEmpty():
        return cuts.select("host", F.lit(0).cast("long").alias("key"), "cuts")

    # Pages with equal blocks may be of different html: those of the hosts that lose something are read again.
    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_digest(blocks(page or "")) for page in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array(found, pa.binary())], names=["host", "key", "content"])

    again = pages.select("host", "key", "html").join(cuts.select("host").distinct(), "host", "left_semi")
    keys = map_arrow(again, digests, "host string, key long, content binary", 256).distinct()
    out = materialize(keys.join(cuts, ["host", "content"]).select("host", "key", "cuts"), "page-cuts")
    discard(cuts)
    return out


def extract(pages: DataFrame, **limits: int) -> DataFrame:
    """Per page row: page_id, url, text. ``limits``: those of :func:`decisions`."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    named = pages.select("page_id", "url", host.alias("host"), F.xxhash64("html").alias("key"), "html")
    cuts = decisions(named, **limits)
    # Pages that lose nothing stay where they are; a filter of fixed size tells most of them.
    flagged = marked(named, bitmap_rows(cuts.select(F.xxhash64("host", "key").alias("k")), "k"), F.xxhash64("host", "key"), "hit")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [_text(blocks(page or ""), cut) for page, cut in zip(batch.column("html").to_pylist(), batch.column("cuts").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kept = "page_id long, url string, text string"
    whole = flagged.where(~F.col("hit")).select("page_id", "url", "html", F.lit(None).cast(_CUTS).alias("cuts"))
    cut = flagged.where("hit").join(cuts, ["host", "key"], "left").select("page_id", "url", "html", "cuts")
    return map_arrow(whole, read, kept, 256).unionByName(map_arrow(cut, read, kept, 256))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
