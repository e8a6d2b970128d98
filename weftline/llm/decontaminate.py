"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of all items' words is built on the driver, in shards of bounded size, and sent to the executors. Each
document streams its words through it: the current state and matching length give, at every word, the longest suffix
that occurs in an item. Where it reaches the window length (or a whole item, if the item is shorter) the words of the
window are hit.

Defined cases: a null text has no words; a null or empty item has no windows; items that share an item_id count as one
item; a null item_id hits words but is never listed; repeated document rows give repeated results; an empty table of
either kind gives what it must, no rows or no hits; other columns are ignored, whatever their names; texts and items may
be of any length, and long items are parted.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import map_arrow
from weftline.storage import fresh, materialize

#: ASCII bytes that are not digits or letters become spaces, upper case becomes lower case, other bytes stay.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(WORD_TABLE).split()


class SuffixAutomaton:
    """All runs of words of all items. ``window``: words that count as an occurrence, or the whole of a shorter item.

    Nearly all states have one way on, which two arrays hold; only those with more have a dict. Items longer than
    ``window`` may come in parts that overlap by ``window - 1`` words.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes], int]], window: int):
        """items: (name, words, number of words of the whole item)."""
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.word, self.then = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words], size) for name, words, size in items if words]
        for _, words, _ in coded:
            last = 0
            for word in words:
                last = self._extend(last, word)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        #: The state of the last ``window`` words of a state's strings, 0 where they are shorter.
        self.anchor = array("i", bytes(4 * len(self.link)))
        for s in order[1:]:
            up = self.link[s]
            self.anchor[s] = self.anchor[up] if self.length[up] >= window else s if self.length[s] >= window else 0
        listed: dict[int, set] = {}
        ends: dict[int, list] = {}
        for name, words, size in coded:
            s = 0
            if size < window:
                for word in words:
                    s = self._next(s, word)
                while self.length[self.link[s]] >= len(words):
                    s = self.link[s]
                ends.setdefault(s, []).append((len(words), name))
                continue
            for at, word in enumerate(words):
                s = self._next(s, word)
                if at >= window - 1:
                    listed.setdefault(self.anchor[s], set()).add(name)
        self.items = {s: tuple(x for x in names if x is not None) for s, names in listed.items()}
        #: Whole short items that end where a state's strings end; most states have none.
        self.short: dict[int, tuple] = {}
        if ends:
            for s in order[1:]:
                if found := (*self.short.get(self.link[s], ()), *ends.get(s, ())):
                    self.short[s] = found

    def _next(self, s: int, word: int) -> int:
        """The state after a word, or -1."""
        return self.then[s] if self.word[s] == word else self.more[s].get(word, -1) if s in self.more else -1

    def _lead(self, s: int, word: int, to: int) -> None:
        if self.word[s] in (-1, word):
            self.word[s], self.then[s] = word, to
        else:
            self.more.setdefault(s, {})[word] = to

    def _state(self, length: int) -> int:
        self.word.append(-1)
        self.then.append(-1)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.word[clone], self.then[clone], self.link[clone] = self.word[q], self.then[q], self.link[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p >= 0 and self._next(p, word) == q:
            self._lead(p, word, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self._next(last, word)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and self._next(p, word) < 0:
            self._lead(p, word, new)
            p = self.link[p]
        if p >= 0:
            q = self._next(p, word)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple]]:
        """(start, end, item names) of every occurrence, by end."""
        ids, first, then, more = self.ids, self.word, self.then, self.more
        link, length, anchor, items, short, window = self.link, self.length, self.anchor, self.items, self.short, self.window
        s = matched = 0
        for at, w in enumerate(words):
            word = ids.get(w)
            if word is None:  # in no item
                s = matched = 0
                continue
            while True:
                if first[s] == word:
                    t = then[s]
                    break
                if s in more and (t := more[s].get(word, -1)) >= 0:
                    break
                s = link[s]  # the root knows every word of the items
                matched = length[s]
            s = t
            matched += 1
            if matched >= window and (a := anchor[s]):
                yield at + 1 - window, at + 1, items.get(a, ())
            if short and s in short:
                for size, name in short[s]:
                    if size <= matched:
                        yield at + 1 - size, at + 1, () if name is None else (name,)


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _hits(automaton: SuffixAutomaton, text: bytes | None) -> tuple[int, list[list[int]], list[str]]:
    """Words, merged spans and sorted item names of one text."""
    words, spans, names = words_of(text), [], set()
    for start, end, found in automaton.matches(words):
        if spans and spans[-1][1] >= start >= spans[-1][0]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
        names.update(found)
    return len(words), _merged(spans), sorted(names)


def _columns(rows: list[tuple[int, list[list[int]], list[str]]]) -> dict[str, pa.Array]:
    return {
        "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
        "n_hit": pa.array([sum(e - s for s, e in spans) for _, spans, _ in rows], pa.int64()),
        "spans": pa.array([[x for span in spans for x in span] for _, spans, _ in rows], pa.list_(pa.int32())),
        "items": pa.array([names for _, _, names in rows], pa.list_(pa.string())),
    }


_FOUND = "n_words long, n_hit long, spans array<int>, items array<string>"


def _scan(shard, only_hits: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = batch.column("text").cast(pa.binary()), [n for n in batch.schema.names if n != "text"]
        rows = [_hits(shard.value, t.as_py()) for t in texts]
        out = pa.RecordBatch.from_pydict({n: batch.column(n) for n in keep} | _columns(rows))
        return out.filter(pa.array([bool(spans) for _, spans, _ in rows], pa.bool_())) if only_hits else out

    return run


def _parts(window: int, most: int):
    """Items as (item, words as one binary, words of the whole item): long ones in parts of ``most`` words that overlap."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, parts, sizes = [], [], []
        for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            for at in range(0, max(len(words) - window + 1, 1) if words else 0, most):
                names.append(name)
                parts.append(b" ".join(words[at : at + most + window - 1]))
                sizes.append(min(len(words), window))
        return pa.RecordBatch.from_pydict({"item": pa.array(names, pa.string()), "part": pa.array(parts, pa.binary()), "size": pa.array(sizes, pa.int32())})

    return run


def _automata(benchmark: DataFrame, window: int, shard_bytes: int) -> list:
    """Functions that each give a broadcast automaton of a shard of the items, of about ``shard_bytes`` bytes at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.length("text") > 0)
    # Repeated items, and a part that many items share, are one row.
    parts = map_arrow(items, _parts(window, max(1, shard_bytes // 64)), "item string, part binary, size int", 256).distinct()
    total = parts.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    shards = -(-2 * total // shard_bytes) if total > shard_bytes else 1

    def build(k: int):
        part = parts if shards == 1 else parts.where(F.pmod(F.xxhash64("item", "part"), F.lit(shards)) == k)
        return spark.sparkContext.broadcast(SuffixAutomaton([(r["item"], bytes(r["part"]).split(), r["size"]) for r in part.collect()], window))

    return [lambda k=k: build(k) for k in range(shards)]


def _merge_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Hits of several shards as those of one."""
    rows = []
    for n, lists, names in zip(batch.column("n_words").to_pylist(), batch.column("all_spans").to_pylist(), batch.column("all_items").to_pylist(), strict=True):
        spans = _merged([[x[i], x[i + 1]] for x in lists for i in range(0, len(x), 2)])
        rows.append((n, spans, sorted({name for x in names for name in x})))
    return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key")} | _columns(rows))


def _shard_hits(documents: DataFrame, automata: list) -> DataFrame:
    """(doc_id, key, n_words, n_hit, spans, items) of the rows that any of several shards hits. Each shard is a pass that
    writes its hits only; key is the hash of the text."""
    keyed, found = documents.select("doc_id", F.xxhash64("text").alias("key"), "text"), []
    for build in automata:
        automaton = build()
        hits = map_arrow(keyed, _scan(automaton, True), f"doc_id long, key long, {_FOUND}", 1024)
        found.append(materialize(hits, "decontaminate"))
        automaton.destroy()
    # Repeated rows have equal hits in a shard.
    hits = reduce(DataFrame.unionByName, [x.withColumn("shard", F.lit(i)).dropDuplicates(["doc_id", "key"]) for i, x in enumerate(found)])
    hits = hits.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("all_spans"), F.collect_list("items").alias("all_items"))
    return map_arrow(hits, _merge_rows, f"doc_id long, key long, {_FOUND}")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 8_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans (word starts and ends, flat) and items (sorted names).

    ``shard_bytes`` bounds the items in one automaton, hence what is sent to executors at a time. A larger benchmark
    is worked off in several passes over the documents, each adding its hits; nothing is left out.
    """
    automata = _automata(benchmark, window, shard_bytes)
    documents = documents.select("doc_id", "text")
    if len(automata) == 1:
        return map_arrow(documents, _scan(automata[0](), False), f"doc_id long, {_FOUND}")
    hits = materialize(_shard_hits(documents, automata), "decontaminate").withColumnsRenamed({"doc_id": "id", "key": "text_key", "n_words": "hit_words"})

    def sized(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(words_of(t.as_py())) for t in batch.column("text").cast(pa.binary())]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_words": pa.array(sizes, pa.int64())})

    sizes = map_arrow(documents.withColumn("key", F.xxhash64("text")), sized, "doc_id long, key long, n_words long")
    none = {"n_hit": F.lit(0).cast("long"), "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    joined = sizes.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")), "left")
    return joined.select("doc_id", "n_words", *[F.coalesce(c, empty).alias(c) for c, empty in none.items()])


def report(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The digest columns of :func:`contamination`."""
    found = contamination(documents, benchmark, window)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _cut(text: str | None, spans: list[int]) -> str | None:
    """The text without its hit words; each removed run takes the separators inside it along."""
    if not spans or text is None:
        return text
    data = text.encode()
    plain = data.translate(WORD_TABLE)
    bounds, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    kept, done = [], 0
    for k in range(0, len(spans), 2):
        kept.append(data[done : bounds[spans[k]][0]])
        done = bounds[spans[k + 1] - 1][1]
    return b"".join([*kept, data[done:]]).decode()


def _clean(batch: pa.RecordBatch, spans_of: list[list[int]], columns: list[str]) -> pa.RecordBatch:
    """Rows without their spans; rows of which no word is left go."""
    keep, texts = [], []
    for i, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), spans_of, strict=True)):
        if spans:
            if sum(spans[1::2]) - sum(spans[::2]) == len(words_of(text)):
                continue
            text = _cut(text, spans)
        keep.append(i)
        texts.append(text)
    out = batch.select(columns).take(pa.array(keep, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else out.column(n) for n in columns], names=columns)


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 8_000_000) -> DataFrame:
    """Documents without their contaminated spans, with all their columns.

    Every hit span is cut out of the text, however long it is or however much of the document is hit; the rest stays.
    Only a document of which no word is left is removed. Documents without hits stay as they are.
    """
    automata, columns = _automata(benchmark, window, shard_bytes), documents.columns
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema.fields])
    if len(automata) == 1:
        shard = automata[0]()

        def once(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [_hits(shard.value, t.as_py())[1] for t in batch.column("text").cast(pa.binary())]
            return _clean(batch, [[x for span in spans for x in span] for spans in found], columns)

        return map_arrow(documents, once, schema)
    id_, key, spans = (fresh(n, documents) for n in ("hit_id", "hit_key", "hit_spans"))
    hits = materialize(_shard_hits(documents.select("doc_id", "text"), automata), "decontaminate").select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("spans").alias(spans))
    joined = documents.join(hits, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left").select(*columns, spans)
    return map_arrow(joined, lambda batch: _clean(batch, [x or [] for x in batch.column(spans).to_pylist()], columns), schema)
