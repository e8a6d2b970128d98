"""Personal data by bootstrapped contextual extraction.

One pass over the texts finds the base entities (the seeds) and, in the same pass, every identifier-shaped token,
or group of numbers written with spaces, with its lexical contexts. Seeds and contexts form a graph of patterns and instances. Spark scores it iteratively: a pattern
is as good as the instances it matches, an instance as good as the accepted patterns that match it. Tokens and groups
that stand in a high-confidence context and have the loose shape of its kind are added as spans, of those with one start
the longest; base spans always stay. A group has the contexts outside of it; it ends where it would exceed 19 digits.

Patterns of a token: the two words to its left, the word to its left with the word to its right, and the word to its
left alone, in lower case and without digits. They end at the next seed, for which its kind stands.

Defined cases: a null text is empty; an empty table gives an empty result; repeated rows give repeated results; other
columns are ignored, whatever their names; of candidates with several accepted patterns the most confident one decides,
then the first kind in the order of ``KINDS``; texts, words and identifiers may be of any length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import bitmap_rows, map_arrow, marked
from weftline.storage import fresh, materialize

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")
#: Numbers joined by spaces, full stops, hyphens, slashes and brackets.
_GROUP = re.compile(r"(?<![\w.@/()+-])\+?\(?[0-9]++(?![\w@])(?:(?!\.\x20)[\x20.()/-]{1,3}+[0-9]++(?![\w@]))+")
_NUMBER = re.compile(r"\+?\(?[0-9]+")
_EDGE = " \t\n\r.,;:!?\"'()[]{}<>|"


def emails(text: str) -> list[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @ outwards: linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base entities, in order of start and then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def loose_kinds(token: str) -> int:
    """Bits of the kinds whose loose shape a token has: what an unseen identifier of the kind may look like."""
    digits = sum("0" <= c <= "9" for c in token)
    groups = len(re.findall(r"[0-9a-fA-F]+", token))
    bits = 1 * ("@" in token and len(token) > 3)
    bits |= 2 * (4 <= groups <= 8 and re.fullmatch(r"[0-9a-fA-F:.\-]+", token) is not None and digits > 0)
    bits |= 4 * (12 <= digits <= 19 and re.fullmatch(r"[0-9./_\x20-]+", token) is not None)
    bits |= 8 * (7 <= digits <= 15 and re.fullmatch(r"\+?[0-9()./_\x20-]+", token) is not None)
    return bits


def _plain(word: str) -> str:
    """A word without digits and marks at its ends, in lower case; of a long one a digest stands for the end."""
    plain = re.sub(r"[0-9]", "", word.strip(_EDGE).lower())
    return plain if len(plain) <= 64 else plain[:32] + hashlib.blake2b(plain.encode("utf-8", "replace"), digest_size=16).hexdigest()


def _left(text: str, at: int, floor: int) -> list[str]:
    """The last two words between ``floor`` and ``at``; a word that ``floor`` cuts counts from there."""
    size = 64
    while True:
        low = max(floor, at - size)
        words = text[low:at].split()
        if low == floor or len(words) > 2 or len(words) == 2 and text[low].isspace():
            return words[-2:]
        size *= 4


def _right(text: str, at: int, ceiling: int) -> list[str]:
    """The first word between ``at`` and ``ceiling``."""
    size = 64
    while True:
        high = min(ceiling, at + size)
        words = text[at:high].split(None, 1)
        if high == ceiling or len(words) > 1 or words and text[high - 1].isspace():
            return words[:1]
        size *= 4


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, first kind) of the ranges that the base spans cover, disjoint and sorted."""
    out: list[tuple[int, int, int]] = []
    for start, kind, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2])
        else:
            out.append((start, end, kind))
    return out


def groups(text: str, seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of groups of numbers between the seeds that are written with spaces, of at most 19 digits each."""
    out, at = [], 0
    for low, high in [*seeds, (len(text), len(text))]:
        for m in _GROUP.finditer(text, at, low) if low > at else ():
            if " " not in m[0]:
                continue
            start = end = digits = 0
            for number in _NUMBER.finditer(text, *m.span()):
                size = sum("0" <= c <= "9" for c in number[0])
                if end and digits + size > 19:
                    out.append((start, end))
                    end = digits = 0
                start, end, digits = start if end else number.start(), number.end(), digits + size
            out.append((start, end))
        at = max(at, high)
    return [(s, e) for s, e in out if " " in text[s:e]]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """Identifier-shaped tokens, groups of numbers and seeds with contexts: (start, end, seed kind or -1, loose bits, instance, patterns)."""
    found = [(s, e, k, 0) for s, k, e in base]
    seeds, at = _merged(base), 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while start < end and text[start] in _EDGE and not (text[start] == "(" and text[start + 1 : start + 2].isdigit()):
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while at < len(seeds) and seeds[at][1] <= start:
            at += 1
        if end > start and not (at < len(seeds) and seeds[at][0] < end) and (bits := loose_kinds(text[start:end])):
            found.append((start, end, -1, bits))
    found += [(s, e, -1, bits) for s, e in groups(text, [(s, e) for s, e, _ in seeds]) if (bits := loose_kinds(text[s:e]))]
    out = []
    starts, ends = [s for s, _, _ in seeds], [e for _, e, _ in seeds]
    for start, end, kind, bits in found:
        # Contexts don't reach beyond the next seed, of which only the kind is told.
        before, after = bisect_right(ends, start) - 1, bisect_left(starts, end)
        left = _left(text, start, ends[before] if before >= 0 else 0)
        right = _right(text, end, starts[after] if after < len(starts) else len(text))
        left = [*([f"<{KINDS[seeds[before][2]]}>"] if before >= 0 and len(left) < 2 else []), *map(_plain, left)][-2:]
        right = [_plain(right[0])] if right else [f"<{KINDS[seeds[after][2]]}>"] if after < len(seeds) else []
        patterns = []
        if len(left) == 2 and all(left):
            patterns.append(f"2:{left[0]} {left[1]}")
        if left and left[-1]:
            patterns.append(f"1:{left[-1]}")
            if right and right[0]:
                patterns.append(f"b:{left[-1]} _ {right[0]}")
        out.append((start, end, kind, bits, hashlib.blake2b(text[start:end].encode("utf-8", "replace"), digest_size=16).digest(), patterns))
    return out


_FOUND = "array<struct<start:int,kind:int,end:int>>"
_CANDIDATES = "array<struct<start:int,end:int,kind:int,bits:int,instance:binary,patterns:array<string>>>"


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    base, cands = [], []
    for text in batch.column("text").to_pylist():
        found = base_spans(text or "")
        base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
        cands.append([dict(zip(("start", "end", "kind", "bits", "instance", "patterns"), c, strict=True)) for c in candidates(text or "", found)])
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("bits", pa.int32()), ("instance", pa.binary()), ("patterns", pa.list_(pa.string()))]))
    return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "base": pa.array(base, span), "cands": pa.array(cands, cand)})


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def score_patterns(edges: DataFrame, rounds: int, min_support: int, min_confidence: float) -> DataFrame:
    """Accepted (pattern, kind, confidence) of a graph of distinct edges (pattern, instance, kind; -1: not a seed).

    In each round the confidence of a pattern for a kind is the mean score of all its instances, where seeds have 1 for
    their own kind; it is accepted with ``min_support`` distinct scored instances and ``min_confidence``. An instance
    that is no seed then scores 1 - prod(1 - confidence) over its accepted patterns.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("kind >= 0").select("pattern", "kind", F.lit(1.0).alias("score"))
    rest = edges.where("kind < 0").select("pattern", "instance")
    scored, accepted = seeds, None
    for turn in range(rounds):
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.count("*").alias("support"))
        accepted = (
            sums.where(F.col("support") >= min_support).join(sizes, "pattern")
            .select("pattern", "kind", (F.col("total") / F.col("n")).alias("confidence"))
            .where(F.col("confidence") >= min_confidence)
        )
        accepted = materialize(accepted, "pii-patterns")
        if turn + 1 < rounds:
            instances = rest.join(accepted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
            scored = seeds.unionByName(rest.join(instances, "instance").select("pattern", "kind", "score"))
    return accepted


def extract(documents: DataFrame, rounds: int = 3, min_support: int = 8, min_confidence: float = 0.9) -> DataFrame:
    """Per document row: doc_id, base and spans, both array<struct<start, kind, end>> sorted by start and kind.

    ``key`` is the hash of the text, so that rows with equal doc_id but other texts stay apart.
    """
    keyed = documents.select("doc_id", F.xxhash64("text").alias("key"), "text")
    found = materialize(map_arrow(keyed, _scan, f"doc_id long, key long, base {_FOUND}, cands {_CANDIDATES}"), "pii-base")
    each = found.select("doc_id", "key", F.explode("cands").alias("c")).select("doc_id", "key", "c.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct()
    accepted = score_patterns(edges, rounds, min_support, min_confidence)
    hits = (
        each.where("kind < 0").select("doc_id", "key", "start", "end", "bits", F.explode("patterns").alias("pattern"))
        .join(accepted, "pattern").where(F.expr("shiftright(bits, kind) & 1 = 1"))
        .groupBy("doc_id", "key", "start").agg(F.max(F.struct("end", "confidence", (-F.col("kind")).alias("k"))).alias("best"))
        .groupBy(F.col("doc_id").alias("id"), F.col("key").alias("text_key"))
        .agg(F.collect_list(F.struct("start", (-F.col("best.k")).alias("kind"), F.col("best.end").alias("end"))).alias("extra"))
    )
    on = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key"))
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_FOUND))))
    return found.select("doc_id", "key", "base").join(hits, on, "left").select("doc_id", "key", "base", spans.alias("spans"))


def report(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    found = extract(documents)
    # A parameter more would be the index in the array: the kind is bound outside.
    of_kind = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    count = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _redacted(name: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True):
            parts, done = [], 0
            for span in spans or ():
                if span["start"] >= done:
                    parts += [text[done : span["start"]], f"[{KINDS[span['kind']].upper()}]"]
                    done = span["end"]
            texts.append(text if not spans else "".join([*parts, text[done:]]))
        keep = [(n, batch.column(n)) for n in batch.schema.names if n != name]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else c for n, c in keep], names=[n for n, _ in keep])

    return run


def redact(documents: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; of overlapping spans the first decides. All columns
    and rows stay. Only texts that have spans move: a bitmap of fixed size tells most of the others."""
    columns = documents.columns
    id_, key, spans, hit_ = (fresh(n, documents) for n in ("pii_id", "pii_key", "pii_spans", "pii_hit"))
    found = extract(documents).where(F.size("spans") > 0).select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("spans").alias(spans))
    found = materialize(found.dropDuplicates([id_, key]), "pii-spans")
    some = bitmap_rows(found.select(F.xxhash64(id_, key).alias("k")), "k")
    flagged = marked(documents, some, F.xxhash64("doc_id", F.xxhash64("text")), hit_)
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key))
    hit = flagged.where(F.col(hit_)).join(found, on, "left").select(*columns, spans)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema.fields])
    return flagged.where(~F.col(hit_)).select(*columns).unionByName(map_arrow(hit, _redacted(spans), schema, 512))
