"""Best-fit packing of documents into sequences of fixed capacity, by exact-complement hashing.

Only the histogram of piece lengths is needed to plan a packing, and it has at most ``capacity`` entries however many
documents there are. The driver plans on it: the exact complements of single lengths, of pairs and of triples are looked
up among the lengths that are left, every combination of up to four that fills a sequence is consumed as often as the
counts allow, and the rest goes by best fit, in decreasing length. A plan is a list of ranges: "the i-th to j-th piece of
this length go to sequences s, s+1, ... at this offset". Spark numbers the pieces of each length (in salted buckets, so
that a length that a third of all pieces have is no hot key) and every piece looks its place up in the plan.

Defined cases: a null text is empty and gives one piece with the end id alone; repeated rows are packed each, at places
of their own; other columns are ignored; an empty table gives an empty result; very long texts are cut into as many pieces
as they need, of a text one batch of ids is in memory.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import WORKER_CACHES
from weftline.storage import materialize

# ---------------------------------------------------------------- tokens

def _byte_class(b: int) -> int:
    if b in b".,":
        return ord("p")
    if b >= 0x80:
        return ord("x") if b == 0xC2 or b >= 0xC4 else ord("a")
    return ord("a") if chr(b).isalnum() or b in b" \t\n\v\f\r" else ord("q")


_CLASSES = bytes(map(_byte_class, range(256)))


def _plain(text: str) -> bool:
    """Whether lower-casing the text and setting its full stops and commas apart changes no pre-token.

    It may where marks stand beside marks (they are one pre-token), and beyond the letters U+00C0 to U+00FF, whose lower
    case depends on nothing but themselves and which no normalisation changes.
    """
    data = text.encode("utf-8", "replace")
    classes = data.translate(_CLASSES)
    return not (b"x" in classes or b"pp" in classes or b"pq" in classes or b"qp" in classes or b"\xc3\x97" in data or b"\xc3\xb7" in data)


class WordCache:
    """Ids of whole texts by a public tokenizer that lower-cases and whose pre-tokenizer parts letters, marks and spaces.

    Pre-tokens are independent, so the ids of each run of a text between spaces are looked up, packed as bytes; runs are
    made from the lower-cased text with full stops and commas set apart wherever that can't change a pre-token. New words
    are tokenized many at a time. ``most`` bounds the cache; beyond it the cache starts anew, which changes no result.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values())
        self.most, self.known = most, {"": b""}
        #: Ids that end a pre-token.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[str]) -> None:
        words = [r for r in runs if r.isalpha() and len(r) <= 64 and _plain(r)]
        if words:  # each is one pre-token, so that one call serves all and the ids are told apart by what ends one
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            packed = ids.tobytes()
            if len(ends) == len(words):
                self.known.update(zip(words, [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        other = [r for r in runs if r not in self.known]
        self.known.update(zip(other, self._encode(other), strict=True))

    def _runs(self, text: str) -> list[str] | None:
        low = text.lower()
        if any(s in low for s in self.special):
            return None
        if _plain(text):
            text = low.replace(".", " .").replace(",", " ,")
        return text.replace("\n", " ").split(" ")

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.most:
            self.known = {"": b""}
        runs = [self._runs(t) for t in texts]
        found = [None if r is None else [*map(self.known.get, r)] for r in runs]
        gaps = [(r, f, [i for i, x in enumerate(f) if x is None]) for r, f in zip(runs, found, strict=True) if f is not None and None in f]
        self._learn([*dict.fromkeys(r[i] for r, _, at in gaps for i in at)])
        for r, f, at in gaps:
            for i in at:
                f[i] = self.known[r[i]]
        return [self._encode([t])[0] if f is None else b"".join(f) for t, f in zip(texts, found, strict=True)]


def _cache(path: str) -> WordCache:
    import os

    if path not in WORKER_CACHES:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        WORKER_CACHES[path] = WordCache(path)
    return WORKER_CACHES[path]


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, salt int"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = _cache(path), np.array([end_id], "<u4").tobytes()
        for batch in _slices(batches):
            rows: list[list] = [[], [], [], [], [], []]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, salt, ids in zip(batch.column("doc_id").to_pylist(), batch.column("salt").to_pylist(), cache.ids(texts), strict=True):
                data = ids + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), salt), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return run


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, buckets: int = 64) -> DataFrame:
    """Per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and a bucket ``salt``."""
    # By row and not by what is in it, so that a row that is repeated very often is in all buckets.
    salted = documents.select("doc_id", "text", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int").alias("salt"))
    return salted.mapInArrow(_cut(tokenizer_path, end_id, capacity), _PIECES)


# ---------------------------------------------------------------- plan


class Plan:
    """Ranges of pieces by length. ``add`` places ``count`` pieces of a length into sequences from ``first`` on."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {n: c for n, c in counts.items() if c > 0}
        self.used: dict[int, int] = defaultdict(int)
        self.ranges: list[tuple[int, int, int, int, int, int]] = []  # length, rank, count, sequence, offset, pieces of the length in each sequence
        self.sequences = 0

    def add(self, length: int, count: int, first: int, offset: int, each: int = 1) -> None:
        """``each`` pieces, one after another, in each of the sequences; ``count`` pieces in all."""
        self.ranges.append((length, self.used[length], count, first, offset, each))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def combination(self, lengths: tuple[int, ...]) -> None:
        """Fill as many sequences as the counts allow with exactly these lengths, which add up to the capacity."""
        need = defaultdict(int)
        for n in lengths:
            need[n] += 1
        times = min(self.left.get(n, 0) // k for n, k in need.items())
        if times:
            offset = 0
            for n, k in need.items():
                self.add(n, times * k, self.sequences, offset, k)
                offset += n * k
            self.sequences += times

    def fits(self, lengths: tuple[int, ...]) -> bool:
        """Whether there are pieces of all these lengths."""
        return all(self.left.get(n, 0) >= lengths.count(n) for n in lengths)

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """The pairs of available lengths with this sum, from the index of pair sums. A sum's entry is made when it is first
        looked up; lengths that run out never come back, and leave it."""
        if total not in self.by_pair:
            half = total // 2
            ends = self.live[1 : half + 1] & self.live[total - half : total][::-1] if 2 <= total <= self.capacity else np.zeros(0, bool)
            self.by_pair[total] = (np.flatnonzero(ends)[::-1] + 1).tolist()
        self.by_pair[total] = [x for x in self.by_pair[total] if self.fits((x, total - x))]
        for x in self.by_pair[total]:
            if self.fits((x, total - x)):
                yield x, total - x

    def triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        """The triples of available lengths with this sum: the index of triple sums names the longest lengths of them, and
        what each leaves is looked up among the pairs."""
        if total not in self.by_triple:
            self.by_triple[total] = [z for z in sorted(self.left, reverse=True) if 3 * z >= total and total - z >= 2]
        kept = []
        for z in self.by_triple[total]:
            some = False
            for x, y in self.pairs(total - z) if z in self.left else ():
                if y <= z and self.fits((x, y, z)):
                    some = True
                    yield x, y, z
            if some:
                kept.append(z)
        self.by_triple[total] = kept

    def exact(self) -> None:
        """Consume combinations of one to four lengths that fill a sequence: the gap that a length leaves is looked up among
        single lengths, then among the sums of pairs and of triples.

        Every combination is taken until a length of it runs out, so a length is left with at most as many pieces as
        a combination needs of it. No combination of lengths that are still available is missed.
        """
        c = self.capacity
        self.live = np.zeros(c + 1, bool)
        self.live[[*self.left]] = True
        self.by_pair: dict[int, list[int]] = {}
        self.by_triple: dict[int, list[int]] = {}
        single = lambda gap: [(gap,)] if gap in self.left else []
        if c in self.left:
            self.combination((c,))
        for sums in (single, self.pairs, self.triples):
            for a in sorted(self.left, reverse=True):
                for rest in sums(c - a):
                    if a not in self.left:
                        break
                    self.combination((a, *rest))

    def best_fit(self) -> None:
        """The rest, longest first, each into the fullest sequence that has room. Sequences alike are handled together."""
        gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap: ranges of sequences [first, count]
        for n in sorted(self.left, reverse=True):
            for gap in sorted(g for g in gaps if g >= n):
                while gap in gaps and n in self.left:
                    first, count = gaps[gap].pop()
                    if not gaps[gap]:
                        del gaps[gap]
                    each = min(gap // n, max(1, self.left[n] // count))
                    take = min(count, self.left[n])
                    self.add(n, take * each, first, self.capacity - gap, each)
                    if count > take:
                        gaps[gap].append([first + take, count - take])
                    if gap > each * n:
                        gaps[gap - each * n].append([first, take])
                if n not in self.left:
                    break
            if n in self.left:
                each = self.capacity // n
                full, rest = divmod(self.left[n], each)
                if full:
                    self.add(n, full * each, self.sequences, 0, each)
                    if self.capacity > each * n:
                        gaps[self.capacity - each * n].append([self.sequences, full])
                    self.sequences += full
                if rest:
                    self.add(n, rest, self.sequences, 0, rest)
                    gaps[self.capacity - rest * n].append([self.sequences, 1])
                    self.sequences += 1


def plan(counts: dict[int, int], capacity: int) -> Plan:
    out = Plan(counts, capacity)
    out.exact()
    out.best_fit()
    return out


class Places:
    """A plan as sorted arrays, to look up the places of many pieces at once."""

    def __init__(self, ranges: list[tuple[int, int, int, int, int, int]]):
        table = np.array(sorted(ranges) or [(0,) * 6], np.int64)
        self.length, self.rank, _, self.first, self.offset, self.each = table.T.copy()
        self.key = (self.length << 44) + self.rank  # ranks below 2^44

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        turn = rank - self.rank[at]
        return self.first[at] + turn // self.each[at], self.offset[at] + turn % self.each[at] * length


# ---------------------------------------------------------------- Spark


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            sequence, offset = places.find(length, rank)
            columns = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, bucket_rows: int = 10_000) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = documents.sparkSession
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), documents.count() // bucket_rows + 1)
    cut = materialize(pieces(documents, tokenizer_path, capacity, end_id, buckets), "pieces")
    by_bucket = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(Places(plan(counts, capacity).ranges))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_bucket.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("inside", inside).join(starts, ["length", "salt"]).withColumn("rank", F.col("inside") + F.col("before"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(shared), schema)
