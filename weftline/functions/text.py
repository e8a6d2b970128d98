"""Text as Column functions: lines, white space, truncation, slugs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All line boundaries of Unicode text, as in Python's splitlines.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def lines(text: Column) -> Column:
    """Stripped lines; blank ones stay as empty strings."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), strip)


def normalise(text: Column) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def clean_space(text: Column) -> Column:
    """Runs of spaces and tabs as one space, three or more line feeds as two, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def shortened(text: Column, size: int) -> Column:
    """At most ``size`` characters, then three dots if anything was cut."""
    return F.when(F.length(text) > size, F.concat(rstrip(F.left(text, F.lit(size))), F.lit("..."))).otherwise(text)


def slug(url: Column) -> Column:
    """A name for files: without scheme and end slashes, other than letters and digits as single underscores."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"/+$", "")
    name = F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))


# Whole lines that are page furniture, as alternatives of one pattern.
NOISE_LINES = (
    r"advertisement", r"advertisements", r"advertise(?:ment)?s?", r"sponsored\s*(?:content|post|links?)?", r"ad", r"ads",
    r"promoted\s*(?:content|stories)?", r"multimedia", r"video", r"videos", r"slideshow", r"gallery", r"photo", r"photos",
    r"play\s+video", r"watch\s+video", r"videocam", r"photo_camera", r"play_arrow", r"play_circle", r"\+?\s*follow(?:\s+us)?",
    r"share(?:\s+this)?", r"tweet", r"email\s+this", r"print", r"read\s+more", r"see\s+more", r"show\s+more", r"load\s+more",
    r"more\s+on\s+this", r"related\s+(?:stories|articles|topics|posts)", r"you\s+may\s+also\s+like", r"recommended\s+for\s+you",
    r"comments?", r"leave\s+a\s+comment", r"post\s+a\s+comment", r"cookie\s+(?:policy|consent|settings|preferences)",
    r"accept\s+(?:all\s+)?cookies?", r"we\s+use\s+cookies", r"sign\s+up\s+(?:for|to)\s+(?:our\s+)?newsletter",
    r"subscribe\s+(?:now|today|for\s+free)", r"skip\s+(?:to\s+)?(?:content|main|navigation)", r"[-–—|•·]{1,3}",
)
NOISE_LINE = r"(?i)^\s*(?:" + "|".join(NOISE_LINES) + r")\s*$"


def without_noise_lines(text: Column) -> Column:
    """The text without furniture lines; blank runs that this leaves are collapsed."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(NOISE_LINE))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def last_index(text: Column, needle: str) -> Column:
    """0-based place of the last occurrence, -1 if there is none."""
    found = F.instr(F.reverse(text), needle[::-1])
    return F.when(found > 0, F.length(text) - found - len(needle) + 1).otherwise(F.lit(-1))


def truncated(text: Column, size: Column, notice: str = "\n\n[Content truncated]") -> Column:
    """At most ``size`` characters and a notice; cut behind the last sentence or line end if over 80 % stay."""
    cut = F.substring(text, F.lit(1), size.cast("int"))
    at = F.greatest(last_index(cut, ". "), last_index(cut, "\n"))
    cut = F.when(at > 0.8 * size, F.substring(text, F.lit(1), (at + 1).cast("int"))).otherwise(cut)
    return F.when(F.length(text) > size, F.concat(rstrip(cut), F.lit(notice))).otherwise(text)
