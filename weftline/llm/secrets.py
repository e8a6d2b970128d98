"""Secret scan with a recursive decoding worklist.

Every text is a layer. A layer is scanned for the base kinds, and what is encoded in it becomes further layers, which go
to the worklist until none is left:

* Percent and Unicode escapes. An escape that decodes to a part of another escape is decoded on the spot, so that one
  layer holds the fixpoint of all nested escapes. Escapes begin with a character that none has inside and never overlap,
  so any order of decoding ends in the same text, and one pass over the layer finds it, however deep they are nested.
* Base64 (both alphabets, also wrapped over lines), whatever its bytes are.
* zlib and gzip data, any number of streams and members, wherever they begin in what the others give. Large ones are
  decompressed in parts that overlap by what a match or an encoded run can span, so that no expansion fills the memory.
* UTF-16 in a decoded layer, as in encoded commands of a shell.

Bytes are read as one character each; the base kinds are ASCII. Each layer tells, for a range of its characters, the
range of its parent that they come from, so that a match in a nested layer is a span of the document. Escapes and base64
only shrink; data that was decompressed on the way to a layer is not decompressed in it again, which ends cycles.

Defined cases: a null text is empty; an empty table gives an empty result; repeated rows give repeated results; other
columns are ignored; several nested matches with the same kind and original range count once; a match of a decoded layer
that has no decoded character is one of its parent and doesn't count again; bad escapes stay as they are; very long texts
take time and memory in proportion to their length. ``max_run`` bounds one part of decompressed data: if a run without
white space is longer, it is scanned in pieces, and ``complete`` is false for the document.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow

KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINT = re.compile(r"(?:passw|secret|token|api_?key)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_STARTER = re.compile(r"[%\\&]")
_DIGITS = frozenset("0123456789")
_HEXADECIMAL = frozenset("0123456789ABCDEFabcdef")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
#: Base64 wrapped over lines: two or more lines, all but the last of 40 characters at least.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_COMPRESSED = re.compile("\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\xff]")

def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches of one layer."""
    out = []
    if _HINT.search(text):
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# ---------------------------------------------------------------- layers


class Layer:
    """A text, and how a range of its characters maps to a range of the parent layer. ``source`` ends at the document.

    ``new``: whether a range has anything that was decoded in this layer. ``opened``: digests of the compressed data on
    the way here.
    """

    __slots__ = ("text", "place", "parent", "new", "opened")

    def __init__(self, text: str, parent: Layer | None = None, place: Callable[[int, int], tuple[int, int]] | None = None, new: Callable[[int, int], bool] | None = None, opened: frozenset = frozenset()):
        self.text, self.parent, self.place, self.new, self.opened = text, parent, place, new, opened

    def source(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            start, end = layer.place(start, end)
            layer = layer.parent
        return start, end


def _allows(head: list[str], c: str) -> str | None:
    """What a character does to an escape that has begun: it goes on, is done, or (None) was none."""
    first, n = head[0], len(head)
    if first == "%":
        return None if c not in _HEXADECIMAL else "done" if n == 2 else "more"
    if first == "\\":
        if n == 1:
            return "more" if c in "uxU" else None
        return None if c not in _HEXADECIMAL else "done" if n == {"u": 5, "x": 3, "U": 9}[head[1]] else "more"
    if n == 1:
        return "more" if c == "#" else None
    hexadecimal = n > 2 and head[2] == "x"
    if n == 2 and c == "x":
        return "more"
    if c == ";":
        return "done" if n > 2 + hexadecimal else None
    return "more" if n < 9 and c in (_HEXADECIMAL if hexadecimal else _DIGITS) else None


def _decoded(head: str) -> str:
    digits = head.strip("%\\uUx&#;")
    code = int(digits, 10 if head.startswith("&#") and head[2] != "x" else 16)
    return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "\ufffd"


def escapes(layer: Layer) -> Layer | None:
    """The layer with all escapes decoded, nested ones too, or None if it has none.

    Escapes that have begun are on a stack; a character goes to the last of them, and what an escape decodes to goes to
    the one before it. What lies between escapes is copied in one piece.
    """
    text = layer.text
    if not ("%" in text or "\\" in text or "&#" in text) or not _ESCAPE.search(text):
        return None
    pieces: list[str] = []
    at: list[int] = []  # where pieces begin in the new text
    low: list[int] = []  # and their sources; a decoded piece is one character
    high: list[int] = []
    made = 0
    stack: list[list[tuple[str, int, int]]] = []

    def emit(piece: str, s: int, e: int) -> None:
        nonlocal made
        if piece:
            pieces.append(piece)
            at.append(made)
            low.append(s)
            high.append(e)
            made += len(piece)

    def flush() -> None:
        for head in stack:
            for c, s, e in head:
                emit(c, s, e)
        stack.clear()

    pos = 0
    while pos < len(text):
        if not stack:
            m = _STARTER.search(text, pos)
            stop = m.start() if m else len(text)
            emit(text[pos:stop], pos, stop)
            pos = stop
            if not m:
                break
        c, s, e = text[pos], pos, pos + 1
        pos += 1
        while True:
            if c in "%\\&":
                stack.append([(c, s, e)])
                break
            if not stack:
                emit(c, s, e)
                break
            head = stack[-1]
            step = _allows([x for x, _, _ in head], c)
            if step is None:
                flush()
                emit(c, s, e)
                break
            head.append((c, s, e))
            if step == "more":
                break
            stack.pop()
            c, s, e = _decoded("".join(x for x, _, _ in head)), head[0][1], head[-1][2]
    flush()
    out = "".join(pieces)
    marks = [0]  # decoded pieces before each piece: those that stand for more characters than they have
    for piece, s, e in zip(pieces, low, high, strict=True):
        marks.append(marks[-1] + (e - s != len(piece)))

    def place(start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(at, start) - 1, bisect_right(at, end - 1) - 1
        plain = lambda k: high[k] - low[k] == len(pieces[k])
        return low[i] + (start - at[i] if plain(i) else 0), low[j] + end - at[j] if plain(j) else high[j]

    def new(start: int, end: int) -> bool:
        return marks[bisect_right(at, end - 1)] > marks[bisect_right(at, start) - 1]

    return Layer(out, layer, place, new, layer.opened)


def _always(start: int, end: int) -> bool:
    return True


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """A layer for each base64 run; in a decoded layer for those that have something decoded."""
    text = layer.text
    runs = [[(m.start(), m.end())] for m in _BASE64.finditer(text)]
    if "\n" in text:
        runs += [[(x.start(), x.end()) for x in _LINE.finditer(text, *m.span())] for m in _WRAPPED.finditer(text)]
    for lines in runs:
        start, end = lines[0][0], lines[-1][1]
        if layer.new is not None and not layer.new(start, end):
            continue
        run = "".join([text[a:b] for a, b in lines]) if len(lines) > 1 else text[start:end]
        if len(run) % 4 == 1:
            run = run[:-1]
        data = base64.b64decode(run.translate({45: "+", 95: "/"}) + "=" * (-len(run) % 4))
        starts = [0]  # characters of the run before each line
        for a, b in lines:
            starts.append(starts[-1] + b - a)

        def place(s: int, e: int, lines=lines, starts=starts, size=len(run)) -> tuple[int, int]:
            first, last = s * 4 // 3, min((e * 8 + 5) // 6, size) - 1
            i, j = bisect_right(starts, first) - 1, bisect_right(starts, last) - 1
            return lines[i][0] + first - starts[i], lines[j][0] + last - starts[j] + 1

        yield Layer(data.decode("latin-1"), layer, place, _always, layer.opened)


# ---------------------------------------------------------------- compressed data


class _Inflated:
    """Decompressed parts of all members of zlib or gzip data; what was read before an error counts. ``consumed``: how many
    bytes whole members have taken up so far, 0 if there was none."""

    def __init__(self, data: bytes | Iterator[bytes], part: int = 1 << 20):
        self.feed = (data[i : i + part] for i in range(0, len(data), part)) if isinstance(data, bytes) else data
        self.part, self.consumed = part, 0

    def __iter__(self) -> Iterator[bytes]:
        engine, pending, given, fresh = zlib.decompressobj(47), b"", 0, True
        while True:
            if not pending:
                pending = next(self.feed, b"")
                given += len(pending)
                if not pending:
                    return
            try:
                out = engine.decompress(pending, self.part)
            except zlib.error:
                return
            fresh = False
            if out:
                yield out
            pending = engine.unconsumed_tail
            if engine.eof:
                # Another member may follow, after zeros that fill up a block.
                self.consumed = given - len(engine.unused_data)
                pending = engine.unused_data.lstrip(b"\0")
                if pending or not fresh:
                    engine, fresh = zlib.decompressobj(47), True


def _is_compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 < 8 and (data[0] * 256 + data[1]) % 31 == 0


def _overlap(text: str) -> int:
    """Where the next part of a stream begins again: before the last three words, which a match can span."""
    at = len(text)
    for _ in range(4):
        at = len(text[:at].rstrip())
        at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at), text.rfind("\t", 0, at), text.rfind("\r", 0, at), 0)
    return at


def compressed_layers(layer: Layer, max_run: int, told: list, small: int = 1 << 20) -> Iterator[Layer]:
    """Layers of everything that is compressed in a decoded layer: after a stream the search goes on behind it, after a
    false start or a broken one a character on.

    What a stream of up to ``small`` bytes gives is one layer, in which further streams are found like here. A larger one
    is read part by part.
    """
    text, at = layer.text, 0
    while m := _COMPRESSED.search(text, at):
        start = at = m.start()
        at += 1
        if not layer.new(start, start + 2) or not _is_compressed(text[start : start + 3].encode("latin-1", "replace")):
            continue
        # Parts of the layer, as far as its characters are bytes.
        raw = (x.encode("latin-1", "replace") for x in (text[i : i + small] for i in range(start, len(text), small)))
        first = next(raw)
        mark = hashlib.blake2b(first, digest_size=16).digest()
        if mark in layer.opened:  # a cycle
            continue
        stream = _Inflated(chain([first], raw))
        parts, held, size = iter(stream), [], 0
        while size <= small and (part := next(parts, None)) is not None:
            held.append(part)
            size += len(part)
        if not held:
            continue
        opened = layer.opened | {mark}
        if size <= small:
            end = start + stream.consumed if stream.consumed else len(text)
            yield Layer(b"".join(held).decode("latin-1"), layer, lambda s, e, whole=(start, end): whole, _always, opened)
        else:
            yield from _large(layer, (start, len(text)), chain(held, parts), opened, max_run, told)
        if stream.consumed:
            at = start + stream.consumed


def _large(layer: Layer, whole: tuple[int, int], parts: Iterator[bytes], opened: frozenset, max_run: int, told: list) -> Iterator[Layer]:
    """Layers of a large stream, part by part."""
    # Compressed data that begins the decompressed data is a stream of its own; with an opened beginning, a cycle.
    head = next(parts)
    while _is_compressed(head):
        mark = hashlib.blake2b(head, digest_size=16).digest()
        if mark in opened:
            return
        read: list[bytes] = []
        probing = [True]

        def kept(head: bytes = head, parts: Iterator[bytes] = parts, read: list = read, probing: list = probing) -> Iterator[bytes]:
            for x in chain([head], parts):
                if probing:
                    read.append(x)
                yield x

        inner = iter(_Inflated(kept()))
        first = next(inner, None)
        probing.clear()
        if first is None:  # it only looked like it
            head, parts = read[0], chain(read[1:], parts)
            break
        opened |= {mark}
        head, parts = first, inner
    carry = ""
    for part in chain([head], parts):
        held = carry + part.decode("latin-1")
        yield Layer(held, layer, lambda s, e: whole, _always, opened)
        carry = held[_overlap(held) :]
        if len(carry) > max_run:
            told.append(True)
            carry = carry[-max_run // 2 :]


def wide_layers(layer: Layer) -> Iterator[Layer]:
    """The text of a decoded layer that is UTF-16, as most of its bytes at even or at odd places are zero."""
    text = layer.text
    zeros = text[0::2].count("\0"), text[1::2].count("\0")
    for lead, code in ((1, "utf-16-le"), (0, "utf-16-be")):
        if len(text) >= 16 and 4 * zeros[lead] > len(text) and 8 * zeros[1 - lead] < zeros[lead]:
            data = bytearray(text[: len(text) & ~1].encode("latin-1", "replace"))
            if code == "utf-16-be":
                data[0::2], data[1::2] = data[1::2], data[0::2]
            units = "".join(map(chr, np.frombuffer(data, "<u2").tolist()))
            yield Layer(units, layer, lambda s, e: (2 * s, 2 * e), _always, layer.opened)


# ---------------------------------------------------------------- worklist


def all_spans(text: str, max_run: int = 16 << 20) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """Base spans, all spans, and whether every layer was opened in whole."""
    base = scan(text)
    spans, told = set(base), []
    work: list[Iterator[Layer]] = [iter([Layer(text)])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.parent is not None:
            for s, k, e in scan(layer.text):
                if layer.new(s, e):
                    start, end = layer.source(s, e)
                    spans.add((start, k, end))
        work.append(base64_layers(layer))
        if layer.parent is not None:
            work.append(compressed_layers(layer, max_run, told))
            work.append(wide_layers(layer))
        if (plain := escapes(layer)) is not None:
            work.append(iter([plain]))
    return base, sorted(spans), not told


_FOUND = "array<struct<start:int,kind:int,end:int>>"


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [all_spans(text or "") for text in batch.column("text").to_pylist()]
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    listed = lambda i: pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in row[i]] for row in rows], span)
    return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "base": listed(0), "spans": listed(1), "complete": pa.array([row[2] for row in rows], pa.bool_())})


def find(documents: DataFrame) -> DataFrame:
    """Per document row: doc_id, base, spans (array<struct<start, kind, end>>) and complete."""
    return map_arrow(documents.select("doc_id", "text"), _scan, f"doc_id long, base {_FOUND}, spans {_FOUND}, complete boolean")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    # A parameter more would be the index in the array: the kind is bound outside.
    of_kind = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    count = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find(documents).select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "complete")
