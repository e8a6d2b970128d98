"""A small document tree over the standard library's tokenizer, and what is read from it.

Used inside vectorised functions only; a tree is never a column. As in a lenient parser, elements nest as written: an end
tag closes the nearest open element of its name, one without an open element is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

# Elements without content, without text, and those that make the sections, the navigation and the outline.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REMOVED = ("script", "style", "noscript", "iframe", "svg", "canvas")
NOT_TEXT = frozenset(("script", "style", "template"))
SECTIONS = ("header", "nav", "main", "article", "section", "aside", "footer")
NAV_CLASSES = frozenset(("nav", "navigation", "menu", "navbar", "header-nav", "main-nav"))
NAV_IDS = frozenset(("nav", "navigation", "main-nav", "menu"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# Words in class and id that mark adverts, and how they are bounded: the start or a hyphen or underscore
# on the left, or the end or one of these on the right.
AD_WORDS = "ad|ads|advert|advertisement|adslot|ad-slot|ad-container|adsbygoogle|sponsored|sponsor|promo|promotion|banner-ad|dfp|doubleclick|taboola|outbrain"
AD = re.compile(rf"(?i)(?:^|[_-])(?:{AD_WORDS})|(?:{AD_WORDS})(?:[_-]|$)")

# Where the main content may be, in order of preference.
MAIN_SELECTORS = ("main", "article", "[role='main']", "#content", "#main-content", ".content", ".main-content", ".post-content", ".article-content")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag in tags]

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node is self or node.tag not in NOT_TEXT:
                stack += reversed(node.children)

    def text(self, separator: str = "") -> str:
        """Text nodes stripped, empty ones left out."""
        return separator.join(t for t in (s.strip() for s in self.strings()) if t)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        given: dict[str, str] = {}
        for name, value in attrs:
            given[name] = value or ""
        node = Node(tag, given, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


#: Ampersands that begin no reference with a semicolon; comments, scripts and styles are found first and left as they are.
_BARE = re.compile(r"<!--.*?-->|<(script|style)\b.*?(?:</\1\b|\Z)|&(?!(?:\#[0-9]+|\#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", re.I | re.S)


def parse(page: str | None, bare_references: bool = True) -> Node:
    """The tree of a page. As in HTML, "&amp" is a reference without its semicolon too, unless ``bare_references`` is false:
    then it is text, as where texts were cut to a length after they had been escaped."""
    page = page or ""
    if not bare_references:
        page = _BARE.sub(lambda m: "&amp;" if m[0] == "&" else m[0], page)
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


class SelectorError(ValueError):
    pass


# Selectors are compiled to predicates over nodes: a compound is a conjunction, a combinator looks at other nodes.
_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
_PART = re.compile(
    rf"""(?P<tag>\*|(?![\d]){_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~^$*|!]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*(?P<flag>[iIsS])?\s*)?\]|::?(?P<pseudo>[A-Za-z-]+)(?P<call>\()?"""
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"^\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)

Test = Callable[[Node], bool]


def _plain_name(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _elements(node: Node) -> list[Node]:
    """The node and its sister elements, in order."""
    return [c for c in node.parent.children if isinstance(c, Node)] if node.parent is not None else [node]


def _place(node: Node, typed: bool, back: bool) -> int:
    """The place among its sisters, from 1; ``typed``: among those of its tag; ``back``: from the end."""
    those = [c for c in _elements(node) if not typed or c.tag == node.tag]
    at = next(i for i, c in enumerate(those) if c is node)
    return len(those) - at if back else at + 1


def _nth(text: str) -> tuple[int, int]:
    """(a, b) of an + b."""
    m = _NTH.match(text)
    if not m:
        raise SelectorError(text)
    if m[1]:
        return 2, int(m[1].lower() == "odd")
    if m[5]:
        return 0, int(m[5])
    return int(m[2] + "1" if m[2] in ("", "+", "-") else m[2]), int((m[3] or "+") + (m[4] or "0"))


def _pseudo(name: str, argument: str | None) -> Test:
    name = name.lower()
    if argument is None:
        fixed: dict[str, Test] = {
            "first-child": lambda n: _place(n, False, False) == 1, "last-child": lambda n: _place(n, False, True) == 1, "only-child": lambda n: len(_elements(n)) == 1,
            "first-of-type": lambda n: _place(n, True, False) == 1, "last-of-type": lambda n: _place(n, True, True) == 1, "only-of-type": lambda n: sum(c.tag == n.tag for c in _elements(n)) == 1,
            "empty": lambda n: not any(isinstance(c, Node) or c for c in n.children), "root": lambda n: n.parent is not None and not n.parent.tag, "any-link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
            "link": lambda n: n.tag in ("a", "area") and "href" in n.attrs, "checked": lambda n: "checked" in n.attrs or "selected" in n.attrs, "disabled": lambda n: "disabled" in n.attrs,
            "enabled": lambda n: n.tag in ("input", "button", "select", "textarea", "option") and "disabled" not in n.attrs, "required": lambda n: "required" in n.attrs,
        }
        if name not in fixed:
            raise SelectorError(name)
        return fixed[name]
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        a, b = _nth(argument)
        typed, back = name.endswith("type"), "last" in name
        return lambda n: (d := _place(n, typed, back) - b) == 0 or a != 0 and d % a == 0 and d // a >= 0
    if name in ("is", "where", "matches", "not"):
        test = _compiled(argument)
        return (lambda n: not test(n)) if name == "not" else test
    if name == "has":
        relative = [_relative(x) for x in _listed(argument)]
        return lambda n: any(r(n) for r in relative)
    if name in ("contains", "-soup-contains"):
        said = argument.strip()
        said = said[1:-1] if said[:1] in "\"'" and said[-1:] == said[:1] else said
        return lambda n: said in "".join(n.strings())
    raise SelectorError(name)


def _relative(text: str) -> Test:
    """The argument of has: below the node, or after a combinator among its children or later sisters."""
    kind = text[0] if text[0] in ">+~" else " "
    test = _compiled(text[1:] if kind != " " else text)

    def found(node: Node) -> bool:
        if kind == " ":
            return any(test(n) for n in node.walk() if n is not node)
        if kind == ">":
            return any(test(c) for c in node.children if isinstance(c, Node))
        after = _elements(node)[_place(node, False, False) :]
        return any(map(test, after[:1] if kind == "+" else after))

    return found


def _listed(text: str) -> list[str]:
    """The members of a list, parted by commas outside of brackets and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    out = [x.strip() for x in [*out, text[at:]]]
    if depth or quote or not all(out):
        raise SelectorError(text)
    return out


def _attribute(name: str, operator: str | None, value: str, fold: bool) -> Test:
    value = value.lower() if fold else value
    tests: dict[str | None, Callable[[str], bool]] = {
        None: lambda x: True, "=": lambda x: x == value, "~=": lambda x: value in x.split(), "^=": lambda x: value != "" and x.startswith(value), "$=": lambda x: value != "" and x.endswith(value),
        "*=": lambda x: value != "" and value in x, "|=": lambda x: x == value or x.startswith(value + "-"), "!=": lambda x: x != value,
    }
    good = tests[operator]
    if operator == "!=":
        return lambda n: name not in n.attrs or good(n.attrs[name])
    return lambda n: name in n.attrs and good(n.attrs[name].lower() if fold else n.attrs[name])


def _compound(text: str, at: int) -> tuple[list[Test], int]:
    """The tests of the compound that begins at a place, and where it ends."""
    tests: list[Test] = []
    while m := _PART.match(text, at):
        if m["tag"] and tests:
            break
        at = m.end()
        if m["tag"]:
            tag = _plain_name(m["tag"]).lower()
            tests.append(lambda n, tag=tag: tag in ("*", n.tag))
        elif m["id"]:
            tests.append(lambda n, x=_plain_name(m["id"]): n.attrs.get("id") == x)
        elif m["cls"]:
            tests.append(lambda n, x=_plain_name(m["cls"]): x in n.classes())
        elif m["attr"]:
            value = next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), "")
            tests.append(_attribute(_plain_name(m["attr"]).lower(), m["op"], value, (m["flag"] or "").lower() == "i"))
        else:
            argument = None
            if m["call"]:
                depth, end = 1, at
                while end < len(text) and depth:
                    depth += {"(": 1, ")": -1}.get(text[end], 0)
                    end += 1
                if depth:
                    raise SelectorError(text)
                argument, at = text[at : end - 1], end
            tests.append(_pseudo(m["pseudo"], argument))
    if not tests:
        raise SelectorError(text)
    return tests, at


def _one(text: str) -> Test:
    """One selector of a list, from left to right: each combinator wraps what is before it."""
    tests, at = _compound(text, 0)
    test: Test = tests[0] if len(tests) == 1 else lambda n, tests=tests: all(t(n) for t in tests)
    while at < len(text):
        m = _COMBINATOR.match(text, at)
        if not m:
            raise SelectorError(text)
        kind = m[1] or " "
        tests, at = _compound(text, m.end())

        def step(n: Node, tests=tests, kind=kind, before=test) -> bool:
            if not all(t(n) for t in tests):
                return False
            if kind in "+~":
                earlier = _elements(n)[: _place(n, False, False) - 1]
                return any(map(before, earlier[-1:] if kind == "+" else earlier))
            up = n.parent
            while up is not None and up.tag:
                if before(up):
                    return True
                if kind == ">":
                    return False
                up = up.parent
            return False

        test = step
    return test


@lru_cache(256)
def _compiled(selector: str) -> Test:
    tests = [_one(x) for x in _listed(selector)]
    return tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests)


def select(root: Node, selector: str, elements: list[Node] | None = None) -> list[Node]:
    """Elements that match a CSS selector, in document order; ``elements`` are those below the root, if they are known."""
    test = _compiled(selector)
    return [n for n in (root.walk() if elements is None else elements) if n.tag and test(n)]


# ---------------------------------------------------------------- what is read from a page


def title(root: Node) -> str | None:
    found = next((n for n in root.walk() if n.tag == "title"), None)
    if found is None or not (text := found.text()):
        found = next((n for n in root.walk() if n.tag == "h1"), None)
        text = found.text() if found is not None else ""
    return text or None


def metas(root: Node) -> dict[str, str]:
    """Contents by name, or by property without one; the last of each counts."""
    out = {}
    for n in root.find_all("meta"):
        name = n.attrs.get("name") or n.attrs.get("property")
        if name and n.attrs.get("content"):
            out[name] = n.attrs["content"]
    return out


def language(root: Node) -> str | None:
    page = next((n for n in root.walk() if n.tag == "html"), None)
    if page is not None and page.attrs.get("lang"):
        return page.attrs["lang"]
    for n in root.find_all("meta"):
        if n.attrs.get("http-equiv", "").lower() == "content-language" and n.attrs.get("content"):
            return n.attrs["content"]
    return None


def headings(root: Node) -> list[dict]:
    """By level, then in document order; empty ones left out."""
    found = {t: [] for t in HEADINGS}
    for n in root.find_all(*HEADINGS):
        if text := n.text():
            found[n.tag].append({"level": int(n.tag[1]), "text": text, "id": n.attrs.get("id")})
    return [h for t in HEADINGS for h in found[t]]


def links(root: Node, base: str | None) -> list[dict]:
    """Distinct by resolved address, the first of each."""
    seen, out, here = set(), [], urlparse(base or "").netloc
    for n in root.find_all("a"):
        href = n.attrs.get("href", "").strip()
        if not href or href.startswith(("#", "javascript:")):
            continue
        try:
            url = urljoin(base, href) if base else href
            place = urlparse(url).netloc
        except ValueError:
            continue
        if url not in seen:
            seen.add(url)
            out.append({"url": url, "text": n.text(" "), "title": n.attrs.get("title"), "external": bool(place) and place != here})
    return out


def images(root: Node, base: str | None) -> list[dict]:
    return [{"url": urljoin(base, n.attrs["src"]) if base else n.attrs["src"], "alt": n.attrs.get("alt", "")} for n in root.find_all("img") if n.attrs.get("src")]


def page_text(root: Node) -> str:
    text = re.sub(r"\n{3,}", "\n\n", root.text("\n"))
    return re.sub(r"[ \t]+", " ", text).strip()


def drop_adverts(root: Node) -> None:
    """All elements whose classes and id say so; collected first, removed then."""
    for n in [n for n in root.walk() if n.tag and ("class" in n.attrs or "id" in n.attrs) and AD.search(f"{' '.join(n.classes())} {n.attrs.get('id', '')}")]:
        n.drop()


def sections(root: Node) -> list[dict]:
    out = []
    for n in root.walk():
        if n.tag in SECTIONS:
            head = min((h for h in n.walk() if h.tag in HEADINGS), key=lambda h: h.tag, default=None)  # the first of the highest level
            text = n.text(" ")
            out.append({
                "tag": n.tag, "id": n.attrs.get("id"), "classes": n.classes(), "heading": (head.text() or None) if head is not None else None,
                "links_count": len(n.find_all("a")), "text_preview": text[:200] + "..." if len(text) > 200 else text,
            })
    return out


def navigation(root: Node, base: str | None) -> list[dict]:
    """Links of all elements that are navigation by tag, class or id, distinct by address."""
    seen, out = set(), []
    for n in root.walk():
        if n.tag == "nav" or NAV_CLASSES & set(n.classes()) or n.attrs.get("id") in NAV_IDS:
            for x in links(n, base):
                if x["url"] not in seen:
                    seen.add(x["url"])
                    out.append({"url": x["url"], "text": x["text"]})
    return out


def forms(root: Node) -> list[dict]:
    out = []
    for n in root.find_all("form"):
        fields = [
            {"type": f.attrs.get("type", "text") if f.tag == "input" else f.tag, "name": f.attrs.get("name"), "id": f.attrs.get("id"), "required": "required" in f.attrs}
            for f in n.find_all("input", "textarea", "select")
        ]
        out.append({"id": n.attrs.get("id"), "action": n.attrs.get("action"), "method": n.attrs.get("method", "get").upper(), "fields": fields})
    return out
