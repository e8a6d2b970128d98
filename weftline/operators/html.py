"""Stored pages to typed columns: extraction and structure, as vectorised functions over (url, html)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import dom
from weftline.functions.text import NOISE_LINE

EXTRACTED = """struct<title:string,text:string,language:string,headings:array<struct<level:int,text:string,id:string>>,
  links:array<struct<url:string,text:string,title:string,external:boolean>>,images:array<struct<url:string,alt:string>>,meta:map<string,string>,error:string>"""
STRUCTURE = """struct<title:string,language:string,sections:array<struct<tag:string,id:string,classes:array<string>,heading:string,links_count:int,text_preview:string>>,
  navigation:array<struct<url:string,text:string>>,internal_links:array<struct<url:string,text:string,title:string,external:boolean>>,external_links:array<struct<url:string,text:string,title:string,external:boolean>>,
  meta:map<string,string>,forms:array<struct<id:string,action:string,method:string,fields:array<struct<type:string,name:string,id:string,required:boolean>>>>,
  outline:array<struct<level:int,text:string,id:string>>,error:string>"""


def _without_noise(text: str) -> str:
    import re

    pattern = re.compile(NOISE_LINE)
    kept = "\n".join(x for x in text.split("\n") if not pattern.match(x))
    return re.sub(r"\n{3,}", "\n\n", kept).strip()


def read_page(page: str | None, url: str | None, wanted: frozenset, selector: str | None, filter_noise: bool, main_content: bool, bare_references: bool = True) -> dict:
    """One page. With a selector the texts of all matches are joined and nothing else is read."""
    out = dict.fromkeys(("title", "text", "language", "headings", "links", "images", "meta", "error"))
    root = dom.parse(page, bare_references)
    if selector is not None:
        try:
            found = dom.select(root, selector)
        except dom.SelectorError:
            return out | {"error": f"Invalid selector: {selector}"}
        if not found:
            return out | {"error": f"Selector did not match any elements: {selector}"}
        text = "\n\n".join(dom.page_text(n) for n in found)
        return out | {"title": dom.title(root), "language": dom.language(root), "text": _without_noise(text) if filter_noise else text}
    for n in root.find_all(*dom.REMOVED):
        n.drop()
    if filter_noise:
        dom.drop_adverts(root)
    scope = root
    if main_content:
        scope = next((found[0] for s in dom.MAIN_SELECTORS if (found := dom.select(root, s))), None) or next((n for n in root.walk() if n.tag == "body"), root)
    text = dom.page_text(scope)
    out |= {"title": dom.title(root), "language": dom.language(root), "text": _without_noise(text) if filter_noise else text, "headings": dom.headings(scope)}
    if "links" in wanted:
        out["links"] = dom.links(scope, url)
    if "images" in wanted:
        out["images"] = dom.images(scope, url)
    if "meta" in wanted:
        out["meta"] = dom.metas(root)
    return out


def extract(
    pages: DataFrame, wanted: tuple[str, ...] = ("links", "images", "meta"), selector: str | None = None, filter_noise: bool = False, main_content: bool = False,
    bare_references: bool = True,
) -> DataFrame:
    """Pages with ``page``, all that is read from them. What isn't ``wanted`` isn't computed. Without
    ``bare_references`` character references count only with their semicolon."""
    want = frozenset(wanted)

    @F.pandas_udf(EXTRACTED)
    def fn(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for html, url in batches:
            rows = [read_page(h, u, want, selector, filter_noise, main_content, bare_references) for h, u in zip(html, url, strict=True)]
            yield pd.DataFrame(rows, columns=["title", "text", "language", "headings", "links", "images", "meta", "error"])

    return pages.withColumn("page", fn("html", "url"))


SELECTED = "array<struct<selector:string,title:string,language:string,text:string,error:string>>"


def read_selected(page: str | None, selectors: tuple[str, ...]) -> list[dict]:
    """What :func:`read_page` gives for each selector, from one tree."""
    root, out = dom.parse(page), []
    elements, whole = list(root.walk()), {"title": dom.title(root), "language": dom.language(root)}
    for selector in selectors:
        one = dict.fromkeys(("title", "language", "text", "error")) | {"selector": selector}
        try:
            found = dom.select(root, selector, elements)
        except dom.SelectorError:
            out.append(one | {"error": f"Invalid selector: {selector}"})
            continue
        if found:
            out.append(one | whole | {"text": "\n\n".join(dom.page_text(n) for n in found)})
        else:
            out.append(one | {"error": f"Selector did not match any elements: {selector}"})
    return out


def selected(pages: DataFrame, selectors: tuple[str, ...]) -> DataFrame:
    """Pages with a row for each selector and ``found``, what :func:`extract` reads with it: a page is parsed once for all."""

    @F.pandas_udf(SELECTED)
    def fn(html: pd.Series) -> pd.Series:
        return pd.Series([read_selected(h, selectors) for h in html], index=html.index, dtype=object)

    return pages.withColumn("found", F.explode(fn("html")))


def read_structure(page: str | None, url: str | None, wanted: frozenset, selector: str | None, bare_references: bool = True) -> dict:
    out = dict.fromkeys(("title", "language", "sections", "navigation", "internal_links", "external_links", "meta", "forms", "outline", "error"))
    root = whole = dom.parse(page, bare_references)
    if selector is not None:
        try:
            found = dom.select(root, selector)
        except dom.SelectorError:
            return out | {"error": f"Invalid selector: {selector}"}
        if not found:
            return out | {"error": f"Selector did not match any elements: {selector}"}
        root = found[0]
    page_node = next((n for n in whole.walk() if n.tag == "html"), None)
    out |= {"title": dom.title(whole), "language": (page_node.attrs.get("lang") or None) if page_node is not None else None}
    links = dom.links(root, url) if wanted & {"internal_links", "external_links"} else []
    made = {
        "sections": lambda: dom.sections(root), "navigation": lambda: dom.navigation(root, url), "internal_links": lambda: [x for x in links if not x["external"]],
        "external_links": lambda: [x for x in links if x["external"]], "meta": lambda: dom.metas(whole), "forms": lambda: dom.forms(root), "outline": lambda: dom.headings(root),
    }
    return out | {k: f() for k, f in made.items() if k in wanted}


def structure(pages: DataFrame, wanted: tuple[str, ...] = ("sections", "navigation", "internal_links", "external_links", "meta", "forms", "outline"), selector: str | None = None, bare_references: bool = True) -> DataFrame:
    """Pages with ``structure``; ``bare_references`` as in :func:`extract`."""
    want = frozenset(wanted)

    @F.pandas_udf(STRUCTURE)
    def fn(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for html, url in batches:
            rows = [read_structure(h, u, want, selector, bare_references) for h, u in zip(html, url, strict=True)]
            yield pd.DataFrame(rows, columns=["title", "language", "sections", "navigation", "internal_links", "external_links", "meta", "forms", "outline", "error"])

    return pages.withColumn("structure", fn("html", "url"))
