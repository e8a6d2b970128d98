"""Removal of repeated substrings by de Bruijn compaction.

Windows of ``size`` consecutive words are the edges of a de Bruijn graph, the runs of ``size - 1`` words its nodes. Only
edges that recur in several documents matter.

1. Edges whose minimizer (the smallest hash of the shorter word runs in the window) occurs in one document only can't
   recur and drop out; a filter of fixed size tells most of them.
2. Consecutive edges of a document that share a minimizer travel as one run. Equal contents give equal runs, whatever
   stands around them, and one row is left of each content, with the coordinates (document, place) of its first
   occurrence. Where a minimizer has one content only, that row is an edge of the graph, of several words.
3. Where a minimizer has several contents the graph may branch: the edges in the first occurrence of each content are
   taken one by one, and those that recur are edges of the graph, again with the coordinates of their first occurrence.
4. The degrees of all nodes are counted. Edges that follow each other at their coordinates through a node with one way
   in and one way out are compacted into a segment; segments that such a node joins, in whatever documents, are joined
   until whole nonbranching paths are left.
5. Each later occurrence of a run or an edge is joined with its path and its source coordinates. Neighbours on a path
   whose coordinates are neighbours too make one long span, which stands for as many words of the source document.
   The source's words are read there and their digest goes along; words are only removed where the document's own words
   have the same digest.

Joins with many rows of one key (a passage that a third of all documents have) take these keys from a broadcast table:
keys with more than a thousandth of the rows, which are a thousand at most.

Defined cases: a null or empty text has no words; of fewer words than a window nothing is removed; an empty table gives
an empty result; rows with equal doc_id are one document, none of them smaller; a row with null doc_id takes nothing
from others and loses nothing; ties cannot arise, since only smaller doc_ids count; other columns are ignored; texts may
be of any length, and one text's spans are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import SPACE, bitmap, bitmap_rows, components, in_bitmap, join_hot, list_array, map_arrow, marked, mix, text_bytes, window_hashes, window_rows, word_hashes, word_spans
from weftline.storage import discard, materialize

_PART = 6  # words of the runs among which a window's minimizer is chosen


def _minimizers(words: np.ndarray, size: int) -> np.ndarray:
    """For each window start (rows ignored) the smallest hash of a shorter run in the window."""
    part = min(_PART, size)
    least, have, want = window_hashes(words, part), 1, size - part + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    starts, ends, rows = word_spans(data, offsets, SPACE)
    return word_hashes(data, starts, ends), rows


def _candidates(size: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, rows = _words(batch.column("text"))
        least = _minimizers(words, size)
        starts, offsets = window_rows(rows, size)
        least, found = least[starts], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b > a:
                found.append(np.unique(least[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], names=["m"])

    return fn


def _runs_of(batch: pa.RecordBatch, size: int, candidates: np.ndarray) -> dict:
    """Candidate edges of a batch of texts and the runs that they make: rows, places, minimizers, hashes and nodes."""
    words, rows = _words(batch.column("text"))
    starts, offsets = window_rows(rows, size)
    least = _minimizers(words, size)[starts]
    keep = np.flatnonzero(in_bitmap(candidates, least))
    row = np.searchsorted(offsets, keep, "right") - 1
    at, least = starts[keep], least[keep]
    edge, check, node = window_hashes(words, size), window_hashes(words, size, seed=99), window_hashes(words, size - 1, seed=7)
    edge, check = edge[at] if len(at) else edge[:0], (check[at] >> np.uint64(33)).astype(np.int32) if len(at) else np.zeros(0, np.int32)
    # A run ends where the row, the minimizer or the sequence of kept edges ends.
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    bounds = np.append(first, len(at))
    count = np.diff(bounds)
    place = (np.arange(len(at)) - np.repeat(first, count)).astype(np.uint64)
    spread = (place * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    run = np.add.reduceat((edge ^ spread) * (spread | np.uint64(1)), first) + count.astype(np.uint64) if len(first) else edge[:0]
    run_check = np.add.reduceat(check.astype(np.int64) * (place.astype(np.int64) * 2 + 3), first) & 0x7FFFFFFF if len(first) else np.zeros(0, np.int64)
    return {"row": row, "start": (at - rows[row]).astype(np.int32), "first": first, "count": count, "m": least[first], "run": run, "run_check": run_check.astype(np.int32), "edge": edge, "check": check, "head": node[at], "tail": node[at + 1]}


_PIECES = "doc_id long, key long, start int, count int, k long, c int, head long, tail long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(size: int, shared):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _runs_of(batch, size, shared.value)
        first = x["first"]
        last = first + x["count"] - 1
        owner = pa.array(x["row"][first])
        columns = [pa.array(x["start"][first]), pa.array(x["count"].astype(np.int32)), _signed(x["run"]), pa.array(x["run_check"]), _signed(x["head"][first]), _signed(x["tail"][last]), _signed(x["m"])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("key").take(owner), *columns], names=["doc_id", "key", "start", "count", "k", "c", "head", "tail", "m"])

    return fn


_AGAIN = np.uint64(0x5851F42D4C957F2D)


def _open_key(run: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return mix(run ^ mix(doc_id.astype(np.int64).view(np.uint64)))


def _open_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A key for each run to be opened, and another if it recurs."""
    keys = _open_key(batch.column("k").to_numpy().view(np.uint64), batch.column("source").to_numpy())
    again = mix(keys[batch.column("again").to_numpy(zero_copy_only=False)] ^ _AGAIN)
    return pa.RecordBatch.from_arrays([_signed(np.concatenate([keys, again]))], names=["k"])


def _edges(size: int, shared, opened):
    """The edges of runs that are opened, one by one; ``again``: the whole run recurs."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _runs_of(batch, size, shared.value)
        keys = _open_key(x["run"], batch.column("doc_id").to_numpy()[x["row"][x["first"]]])
        chosen = in_bitmap(opened.value, keys)
        again = np.repeat(chosen & in_bitmap(opened.value, mix(keys ^ _AGAIN)), x["count"])
        chosen = np.repeat(chosen, x["count"])
        owner = pa.array(x["row"][chosen])
        columns = [pa.array(x["start"][chosen]), pa.array(np.ones(int(chosen.sum()), np.int32)), _signed(x["edge"][chosen]), pa.array(x["check"][chosen]), _signed(x["head"][chosen]), _signed(x["tail"][chosen]), pa.array(again[chosen])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("key").take(owner), *columns], names=["doc_id", "key", "start", "count", "k", "c", "head", "tail", "again"])

    return fn


def _sources(pieces: DataFrame, **more: Column) -> DataFrame:
    """One row of each content (k, c): the coordinates of its first occurrence, the last document, and the occurrences."""
    rows = pieces.groupBy("k", "c").agg(F.min(F.struct("doc_id", "key", "start")).alias("at"), F.max("doc_id").alias("last"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("count", "head", "tail")], *[x.alias(name) for name, x in more.items()])
    return rows.select("k", "c", F.col("at.doc_id").alias("source"), F.col("at.key").alias("source_key"), F.col("at.start").alias("source_start"), "last", "n", "count", "head", "tail", *more)


def _compacted(graph: DataFrame) -> DataFrame:
    """The edges (k, c, level) of the graph with the id of their nonbranching path."""
    ends = graph.select(F.col("head").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(graph.select(F.col("tail").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    through = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out = 1 and into = 1").select("node", F.lit(True).alias("through"))
    placed = graph.join(through.withColumnRenamed("node", "head"), "head", "left")
    # Edges that follow each other at their coordinates, through such a node, are one segment.
    order = Window.partitionBy("source", "source_key").orderBy("source_start", "level", "k")
    follows = F.col("through") & (F.lag("tail").over(order) == F.col("head")) & (F.lag(F.col("source_start") + F.col("count")).over(order) == F.col("source_start"))
    marked = placed.withColumn("begins", F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.xxhash64("k", "c", "level")))
    marked = marked.withColumn("segment", F.last("begins", ignorenulls=True).over(order))
    marked = materialize(marked.select("k", "c", "level", "segment", "head", "tail", "through", F.col("begins").isNotNull().alias("begins")), "segments")
    # Segments that begin at a node with one way in and out are joined to the one that ends there.
    begin = marked.where("begins and through").select(F.col("head").alias("node"), F.col("segment").alias("a"))
    end = marked.select(F.col("tail").alias("node"), F.col("segment").alias("b"))
    labels = components(begin.join(end, "node").select("a", "b"))
    return marked.join(labels.withColumnRenamed("node", "segment"), "segment", "left").select("k", "c", "level", F.coalesce("label", "segment").alias("path"))


_SPAN = "start:int,end:int,source:long,source_key:long,source_start:int"


def _long_spans(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The pieces of each text, merged where neighbours on a path have neighbouring coordinates."""
    lists = batch.column("pieces")
    ends_of = lists.offsets.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends_of))
    fields = lists.flatten()
    start, end, source, key, source_start, path = (fields.field(c).to_numpy().astype(np.int64) for c in ("start", "end", "source", "source_key", "source_start", "path"))
    n_paths = np.bincount(np.unique(np.stack([row, path]), axis=1)[0], minlength=batch.num_rows) if len(row) else np.zeros(batch.num_rows, np.int64)
    order = np.lexsort((end, start, source_start - start, path, key, source, row))
    row, start, end, source, key, source_start, path = (x[order] for x in (row, start, end, source, key, source_start, path))
    same = np.ones(len(row), bool)
    for x in (row, source, key, path, source_start - start):
        same[1:] &= x[1:] == x[:-1]
    same[:1] = False
    # The furthest end so far in a group of equal coordinates; groups are kept apart by an offset.
    group = np.cumsum(~same) << 33
    furthest = np.maximum.accumulate(end + group) - group
    new = ~same
    new[1:] |= start[1:] > furthest[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    spans = pa.StructArray.from_arrays(
        [pa.array(x.astype(t)) for x, t in ((start[first], np.int32), (furthest[last], np.int32), (source[first], np.int64), (key[first], np.int64), (source_start[first], np.int32))],
        names=["start", "end", "source", "source_key", "source_start"],
    )
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=batch.num_rows))])
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), list_array(offsets, spans), pa.array(n_paths.astype(np.int32))], names=["doc_id", "key", "spans", "n_paths"])


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # at bytes 0x20 and 0x09 to 0x0D


def _digest(words: list[bytes], start: int, end: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start:end]), digest_size=16).digest()


def _read(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Digests of the words that are asked for, (start, size) each."""
    found = []
    for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
        words = _split(text)
        found.append([{"source_start": x["source_start"], "size": x["size"], "digest": _digest(words, x["source_start"], x["source_start"] + x["size"])} for x in wanted])
    kind = pa.list_(pa.struct([("source_start", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())]))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found, kind)], names=["doc_id", "key", "found"])


def _verified(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, key, spans, n_paths) with the digest of the source's words in each span: array<struct<start,end,digest>>."""
    each = spans.select("doc_id", "key", "n_paths", F.explode("spans").alias("x")).select("doc_id", "key", "n_paths", "x.*", F.expr("x.end - x.start").alias("size"))
    coordinates = ["source", "source_key", "source_start", "size"]
    asked = materialize(each.groupBy(*coordinates).agg(F.count("*").alias("n")), "asked")
    wanted = asked.groupBy(F.col("source").alias("doc_id"), F.col("source_key").alias("key")).agg(F.collect_list(F.struct("source_start", "size")).alias("wanted"))
    some = bitmap_rows(asked.select(F.xxhash64("source", "source_key").alias("k")), "k")
    sources = _marked(keyed, some).where("hit").select("doc_id", "key", "text").dropDuplicates(["doc_id", "key"])
    read = map_arrow(sources.join(wanted, ["doc_id", "key"]), _read, "doc_id long, key long, found array<struct<source_start:int,size:int,digest:binary>>", 256)
    read = read.select(F.col("doc_id").alias("source"), F.col("key").alias("source_key"), F.explode("found").alias("x")).select("source", "source_key", "x.*")
    read = materialize(read.join(asked, coordinates), "digests")
    told = join_hot(each, read, coordinates, lambda d: d.select("doc_id", "key", "n_paths", F.struct("start", "end", "digest").alias("x")))
    out = materialize(told.groupBy("doc_id", "key").agg(F.collect_list("x").alias("spans"), F.max("n_paths").alias("n_paths")), "verified")
    discard(asked, read)
    return out


def _marked(keyed: DataFrame, some: DataFrame) -> DataFrame:
    """(doc_id, key, text, hit): whether a filter of hashes of doc_id and key has the row."""
    return marked(keyed, some, F.xxhash64("doc_id", "key"), "hit")


def covered_spans(documents: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, key, spans, n_paths) of the documents with words to remove: spans are array<struct<start, end, digest>> of
    word places (unsorted, may overlap) with the digest of the source's words, key is the hash of the text, n_paths the
    compacted paths that they lie on."""
    texts = documents.select("text")
    spark = documents.sparkSession
    counted = map_arrow(texts, _candidates(size), "m long", 512).groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    shared = spark.sparkContext.broadcast(bitmap(materialize(counted, "minimizers"), "m"))
    keyed = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("key"), "text")
    runs = materialize(map_arrow(keyed, _runs(size, shared), _PIECES + ", m long", 512), "runs")
    contents = materialize(_sources(runs, m=F.min("m")), "contents")
    branching = materialize(contents.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m"), "branching")
    todo = contents.join(branching, "m", "left_semi").select("k", "source", (F.col("source") < F.col("last")).alias("again"))
    opened = spark.sparkContext.broadcast(bitmap(map_arrow(todo, _open_keys, "k long", 1 << 16), "k"))
    edges = materialize(map_arrow(keyed, _edges(size, shared, opened), _PIECES + ", again boolean", 512), "edges")
    shared.destroy()
    opened.destroy()
    single = materialize(_sources(edges, again=F.max("again")).where("source < last or again").drop("again"), "repeated")
    repeated = contents.where("source < last")
    graph = repeated.join(branching, "m", "left_anti").select(F.lit(1).alias("level"), *single.columns).unionByName(single.withColumn("level", F.lit(2)))
    paths = materialize(_compacted(graph.drop("n", "last")), "paths")
    # Runs of minimizers with several contents are paths of their own.
    pieces = []
    for level, occurrences, sources in ((1, runs, repeated), (2, edges, single.where("source < last"))):
        on = paths.where(F.col("level") == level).select("k", "c", "path")
        sources = materialize(sources.select("k", "c", "n", "source", "source_key", "source_start").join(on, ["k", "c"], "left").withColumn("path", F.coalesce("path", "k")), "sources")
        later = lambda d: d.where("source < doc_id").select("doc_id", "key", "start", (F.col("start") + F.col("count") + size - 1).alias("end"), "source", "source_key", "source_start", "path")
        pieces.append(join_hot(occurrences.select("doc_id", "key", "start", "count", "k", "c"), sources, ["k", "c"], later))
    whole = pieces[0].unionByName(pieces[1]).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end", "source", "source_key", "source_start", "path")).alias("pieces"))
    spans = materialize(map_arrow(whole, _long_spans, f"doc_id long, key long, spans array<struct<{_SPAN}>>, n_paths int"), "spans")
    discard(runs, edges, contents, single, paths)
    out = _verified(keyed, spans)
    discard(spans)
    return out


def _kept(size: int, texts: bool):
    """Digest columns, or the kept words as text."""

    def one(text: str | None, spans: list[dict] | None) -> tuple[int, int, bytes]:
        words = _split(text)
        spans = [x for x in spans or () if _digest(words, x["start"], x["end"]) == x["digest"]]
        if not spans:
            return len(words), 0, b" ".join(words)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, [x["start"] for x in spans], 1)
        np.add.at(change, [x["end"] for x in spans], -1)
        keep = (np.cumsum(change)[:-1] == 0).tolist()
        return len(words), len(words) - sum(keep), b" ".join([w for w, k in zip(words, keep, strict=True) if k])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        last = [k.decode() if texts else hashlib.sha256(k).hexdigest() for _, _, k in rows]
        made = [pa.array([n for n, _, _ in rows], pa.int64()), pa.array([r for _, r, _ in rows], pa.int64()), pa.array(last, pa.string())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, batch.column("n_paths")], names=["doc_id", "n_words", "n_removed", "kept" if texts else "kept_sha256", "n_paths"])

    return run


def deduplicate(documents: DataFrame, size: int = 13, texts: bool = True) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, the kept words joined by spaces (or their SHA-256), and n_paths, the
    compacted paths that the removed words lie on."""
    spans = covered_spans(documents, size)
    # Texts that lose nothing stay where they are; a filter of fixed size tells most of them.
    lost = bitmap_rows(spans.select(F.xxhash64("doc_id", "key").alias("k")), "k")
    schema = "doc_id long, n_words long, n_removed long, " + ("kept string" if texts else "kept_sha256 string") + ", n_paths int"
    keyed = documents.select("doc_id", F.xxhash64("text").alias("key"), "text")
    flagged = _marked(keyed, lost)
    none = F.lit(None).cast("array<struct<start:int,end:int,digest:binary>>")
    clean = flagged.where(~F.col("hit")).select("doc_id", "text", none.alias("spans"), F.lit(0).alias("n_paths"))
    # Null ids never join; they come through the left join without spans.
    touched = flagged.where("hit").select("doc_id", "key", "text").join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans", F.coalesce("n_paths", F.lit(0)).alias("n_paths"))
    kept = _kept(size, texts)
    return map_arrow(clean, kept, schema, 512).unionByName(map_arrow(touched, kept, schema, 512))


def report(documents: DataFrame, size: int = 13) -> DataFrame:
    return deduplicate(documents, size, texts=False).drop("n_paths")
