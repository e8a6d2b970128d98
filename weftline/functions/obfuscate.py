"""Obfuscation of recorded pages: personal data, visible text and images, with markup kept."""

from __future__ import annotations

import hashlib
import re
from itertools import cycle

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of replacement text.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum "
    "fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()

# What counts as an e-mail address and as a phone number, and the placeholder of images.
EMAIL = re.compile(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")
PHONE = re.compile(r"(?<!\d)(?:\+?\d{1,3}[\s\-.]?)?(?:\(?\d{2,4}\)?[\s\-.]?)\d{3,4}[\s\-.]?\d{3,4}(?!\d)")
PLACEHOLDER = (
    "data:image/svg+xml,%3Csvg xmlns='http://www.w3.org/2000/svg' width='400' height='300'%3E%3Crect width='100%25' height='100%25' fill='%23ddd'/%3E"
    "%3Ctext x='50%25' y='50%25' dominant-baseline='middle' text-anchor='middle' fill='%23999' font-size='18'%3Eplaceholder%3C/text%3E%3C/svg%3E"
)
# Elements whose text stays.
KEPT = frozenset(("script", "style", "code", "pre", "textarea", "noscript", "template"))


def scrub_pii_text(text: str) -> str:
    """Addresses as x of the same length, digits of phone numbers as 0."""
    text = EMAIL.sub(lambda m: "x" * len(m[0]), text)
    return PHONE.sub(lambda m: re.sub(r"\d", "0", m[0]), text)


def lorem(length: int, seed: str) -> str:
    """Words of exactly ``length`` characters, cut or filled up with spaces; the first is chosen by the MD5 of the seed.
    No word is added that would go more than 5 characters beyond."""
    first = int(hashlib.md5(seed.encode("utf-8", "replace")).hexdigest()[:8], 16) % len(LOREM)
    words, size = [], -1  # size of the words joined by spaces
    for word in cycle(LOREM[first:] + LOREM[:first]):
        if size >= length or size + 1 + len(word) > length + 5:
            break
        words.append(word)
        size += 1 + len(word)
    text = " ".join(words)
    return text[:length].rstrip() if len(text) > length else text.ljust(length)


#: What isn't text: comments, declarations, instructions, tags with their attributes, and references to characters.
_MARKUP = re.compile(r"""<!--.*?-->|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?:[^>"']|"[^"]*"|'[^']*')*>|&(?:\#[0-9]+|\#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?""", re.S)
_RAW = re.compile(r"</(script|style)\b", re.I)


def scrub_page_text(page: str) -> str:
    """Markup as it is written, with every piece of text outside of kept elements replaced by one of the same length. An
    end tag closes the nearest open element of its name with all inside it; one without an open element closes nothing."""
    out, open_, at = [], [], 0

    def text(piece: str) -> str:
        return piece if not piece.strip() or not KEPT.isdisjoint(open_) else lorem(len(piece), piece)

    while m := _MARKUP.search(page, at):
        out += [text(page[at : m.start()]), m[0]]
        at, tag = m.end(), (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag in open_:
                del open_[len(open_) - 1 - open_[::-1].index(tag) :]
        elif not m[0].endswith("/>"):
            open_.append(tag)
            if tag in ("script", "style"):  # no markup inside
                stop = next((x.start() for x in _RAW.finditer(page, at) if x[1].lower() == tag), len(page))
                out.append(page[at:stop])
                at = stop
    return "".join([*out, text(page[at:])])


def _vectorised(fn):
    @F.pandas_udf("string")
    def udf(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))

    return udf


def scrub_pii(text: Column) -> Column:
    return _vectorised(scrub_pii_text)(text)


def scrub_text(page: Column) -> Column:
    return _vectorised(scrub_page_text)(page)


def scrub_media(page: Column) -> Column:
    """Sources of images, single and in sets, as the placeholder; native."""
    sources = F.regexp_replace(page, r"""(?i)(<img\b[^>]*?\ssrc\s*=\s*)(["'])[^"']*\2""", "$1\"" + PLACEHOLDER + "\"")
    return F.regexp_replace(sources, r"""(?i)(<img\b[^>]*?\ssrcset\s*=\s*)(["'])[^"']*\2""", "$1\"" + PLACEHOLDER + "\"")


def obfuscate(page: Column) -> Column:
    return scrub_media(scrub_text(scrub_pii(page)))
