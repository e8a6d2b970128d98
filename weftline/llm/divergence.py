"""Divergence of sources: how far the term frequencies of the sources of a language lie apart.

Every source gives each kept term of its language a smoothed share p, in whole numbers. The divergence of two sources is
the sum of abs(p - q) over all kept terms, which is split by how many sources have a term:

* heavy terms, that many sources have, are columns of dense numpy tiles of shares, and tiles are subtracted;
* light terms are postings. A source without a term gives it its base share, so two sources that both lack it differ by
  their bases. Postings correct that: of one source against the base of the other, from running sums over its sorted
  shares, and of both, where the postings of two sources meet.

Terms are dealt to chunks and sources to tiles of bounded size. A task works on two tiles of sources and a chunk of terms;
dense and sparse parts are whole numbers and are added by Spark, so the results are exact.

Defined cases: null text, lang and source are empty ones; a text without terms counts for its (lang, source) only, which
has rows like any other; without kept terms all divergences are 0; repeated rows each count as a document; equal values
rank by item, in the order of its UTF-8 bytes; an empty table gives an empty result; other columns are ignored; texts may
be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import drop_caches, trim
from weftline.llm.lexical import terms_of
from weftline.storage import discard, materialize

#: What is between terms: ASCII other than letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False

_KEYS = ["lang", "source", "term"]


def _slice_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a slice of documents."""
    found, at = terms_of(batch.column("text"), _BETWEEN)
    coded = found.dictionary_encode()
    group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
    names = pa.Table.from_struct_array(group)
    keyed = names.append_column("row", pa.array(np.arange(len(names)))).group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
    of = np.empty(len(names), np.int64)
    for g, rows in enumerate(keyed.column("row_list")):
        of[rows.values.to_numpy()] = g
    width = max(len(coded.dictionary), 1)
    cell, n = np.unique(np.repeat(np.arange(len(names)), np.diff(at)) * width + coded.indices.to_numpy(), return_counts=True)  # by document and term
    order = np.argsort(key := of[cell // width] * width + cell % width, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    docs = np.diff(np.append(first, len(key)))
    n = np.add.reduceat(n, first) if len(key) else n
    group, term = pa.array(key[first] // width), pa.array(key[first] % width)
    return pa.table({"lang": keyed.column("lang").take(group), "source": keyed.column("source").take(group), "term": coded.dictionary.take(term).cast(pa.string()), "n": n, "docs": docs})


def _counts(rows: int, most: int):
    """Counts of a partition, added up as long as there are fewer than ``most`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        held: list[pa.Table] = []
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held.append(_slice_counts(batch.slice(at, rows)))
                if len(held) > 1 and sum(x.num_rows for x in held) > most:
                    held = [_added(held)]
                    if held[0].num_rows > most // 2:
                        yield from held[0].to_batches(1 << 16)
                        held = []
        if held:
            yield from _added(held).to_batches(1 << 16)
        del held
        trim()

    return run


def _added(parts: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(parts).combine_chunks().group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return total.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (N + 5 V)), in decimals, whose products don't overflow. Without kept terms nothing uses it."""
    wide = lambda x: x.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(count + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(F.greatest(total + 5 * terms, F.lit(1))))


def term_counts(documents: DataFrame, least_docs: int = 30, rows: int = 1024, most: int = 600_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: all (lang, source); (lang, term, docs, total, groups) of the kept terms; and (lang, source, term, n) of
    kept terms, with what their language has of them."""
    named = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = materialize(named.select("lang", "source").distinct(), "divergence-groups")
    counted = named.where(F.length("text") > 0).mapInArrow(_counts(rows, most), "lang string, source string, term string, n long, docs long")
    counts = materialize(counted.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("groups")).where(F.col("docs") >= least_docs)
    kept = materialize(kept, "divergence-terms")
    found = materialize(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "divergence-kept")
    discard(counts)
    return groups, kept, found


def _payload(tile: pd.DataFrame) -> pd.DataFrame:
    """The entries of one tile and chunk, ordered by term and member, as arrays."""
    tile = tile.sort_values(["slot", "member"])
    out = {"lang": tile["lang"].iloc[0], "tile": tile["tile"].iloc[0], "chunk": tile["chunk"].iloc[0]}
    for c, kind in (("slot", np.int32), ("member", np.int32), ("p", np.int64), ("heavy", np.bool_)):
        out[c] = tile[c].to_numpy(kind).tobytes()
    return pd.DataFrame([out])


class _Tile:
    """Members' base shares, and the entries (term, member, share) of a chunk: heavy ones as a matrix, light ones sorted."""

    def __init__(self, bases: np.ndarray, slot: np.ndarray, member: np.ndarray, p: np.ndarray, heavy: np.ndarray):
        self.bases = bases
        self.heavy_slots = np.unique(slot[heavy])
        self._heavy = slot[heavy], member[heavy], p[heavy]
        self.slot, self.member, self.p = slot[~heavy], member[~heavy], p[~heavy]
        order = np.lexsort((self.p, self.member))
        self.sorted_p, self.bounds = self.p[order], np.searchsorted(self.member[order], np.arange(len(bases) + 1))
        self.running = np.concatenate([[0], np.cumsum(self.sorted_p)])

    def dense(self, slots: np.ndarray) -> np.ndarray:
        out = np.repeat(self.bases[:, None], len(slots), 1)
        slot, member, p = self._heavy
        out[member, np.searchsorted(slots, slot)] = p
        return out

    def against_bases(self, other: np.ndarray) -> np.ndarray:
        """By member and base b of another: the sum over the member's light terms of |p - b| - |own base - b|."""
        out = np.empty((len(self.bases), len(other)), np.int64)
        for m, own in enumerate(self.bases):
            low, high = self.bounds[m], self.bounds[m + 1]
            at = low + np.searchsorted(self.sorted_p[low:high], other)
            below, above = self.running[at] - self.running[low], self.running[high] - self.running[at]
            out[m] = other * (at - low) - below + above - other * (high - at) - (high - low) * np.abs(own - other)
        return out


def _corrections(a: _Tile, b: _Tile) -> np.ndarray:
    """By member of a and of b: what the terms of a chunk add to the difference of the base shares in each of its terms."""
    slots = np.union1d(a.heavy_slots, b.heavy_slots)
    x, y = a.dense(slots), b.dense(slots)
    gap = np.abs(a.bases[:, None] - b.bases[None, :])
    out = np.stack([np.abs(y - row).sum(1) for row in x]) - len(slots) * gap
    out += a.against_bases(b.bases) + b.against_bases(a.bases).T
    # Where postings of both meet in a term: each posting of a with all those of b with its term.
    low, high = np.searchsorted(b.slot, a.slot), np.searchsorted(b.slot, a.slot, "right")
    n = high - low
    left = np.repeat(np.arange(len(n)), n)
    right = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    p, q, i, j = a.p[left], b.p[right], a.member[left], b.member[right]
    np.add.at(out, (i, j), np.abs(p - q) - np.abs(p - b.bases[j]) - np.abs(a.bases[i] - q) + gap[i, j])
    return out


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, tile, other, member, partner, value) for the pairs of two tiles' members, in one chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            tiles = [_Tile(np.array(row[f"{s}_bases"], np.int64), *[np.frombuffer(row[f"{s}_{c}"] or b"", kind) for c, kind in (("slot", np.int32), ("member", np.int32), ("p", np.int64), ("heavy", np.bool_))]) for s in ("a", "b")]
            value = _corrections(*tiles)
            i, j = (x.ravel() for x in np.indices(value.shape))
            fixed = {c: pa.array([row[c]] * len(i), kind) for c, kind in (("lang", pa.string()), ("tile", pa.int32()), ("other", pa.int32()))}
            yield pa.RecordBatch.from_pydict(fixed | {"member": pa.array(i, pa.int32()), "partner": pa.array(j, pa.int32()), "value": pa.array(value.ravel())})


def pair_divergence(groups: DataFrame, kept: DataFrame, found: DataFrame, heavy_groups: int = 8, tile_groups: int = 128, chunk_terms: int = 4096) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language, both ways.

    ``groups``: (lang, source, total, terms), terms being those kept of the language. Terms that more than
    ``heavy_groups`` sources have are heavy. A tile has about ``tile_groups`` sources and a chunk ``chunk_terms`` terms.
    """
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    counts = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile_groups).alias("tiles"), F.greatest(F.ceil(F.max("terms") / chunk_terms), F.lit(1)).alias("chunks"))
    counts = materialize(counts, "divergence-sizes")
    ordered = Window.partitionBy("lang", "tile").orderBy("source")
    members = groups.join(counts, "lang").withColumn("tile", dealt("source", F.col("tiles"))).withColumn("base", _share(F.lit(0), F.col("total"), F.col("terms")))
    members = materialize(members.withColumn("member", F.row_number().over(ordered) - 1).select("lang", "tile", "member", "source", "base", "total", "terms"), "divergence-members")
    slots = kept.join(counts, "lang").withColumn("chunk", dealt("term", F.col("chunks")))
    slots = slots.select("lang", "term", "chunk", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("slot"), (F.col("groups") > heavy_groups).alias("heavy"))
    entries = found.select("lang", "source", "term", "n").join(slots, ["lang", "term"]).join(members, ["lang", "source"])
    entries = entries.select("lang", "tile", "chunk", "slot", "member", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "heavy")
    cells = entries.groupBy("lang", "tile", "chunk").applyInPandas(_payload, "lang string, tile int, chunk int, slot binary, member binary, p binary, heavy binary")
    # Every tile has a cell in every chunk, if an empty one: its members' base shares are what others are held against.
    tiles = members.groupBy("lang", "tile").agg(F.transform(F.sort_array(F.collect_list(F.struct("member", "base"))), lambda x: x["base"]).alias("bases"))
    frame = tiles.join(counts, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    cells = materialize(frame.join(cells, ["lang", "tile", "chunk"], "left"), "divergence-cells")
    sides = ("bases", "slot", "member", "p", "heavy")
    a = cells.select("lang", "chunk", "tile", F.explode(F.sequence(F.col("tile"), F.col("tiles").cast("int") - 1)).alias("other"), *[F.col(c).alias(f"a_{c}") for c in sides])
    b = cells.select("lang", "chunk", F.col("tile").alias("other"), *[F.col(c).alias(f"b_{c}") for c in sides])
    parts = a.join(b, ["lang", "chunk", "other"]).select("lang", "tile", "other", *[f"{s}_{c}" for s in "ab" for c in sides]).mapInArrow(_tile_pairs, "lang string, tile int, other int, member int, partner int, value long")
    sums = materialize(parts.groupBy("lang", "tile", "other", "member", "partner").agg(F.sum("value").alias("value")), "divergence-pairs")
    names = lambda tile, member, source, base: members.select("lang", F.col("tile").alias(tile), F.col("member").alias(member), F.col("source").alias(source), F.col("base").alias(base), "terms")
    whole = sums.join(names("tile", "member", "source", "base"), ["lang", "tile", "member"]).join(names("other", "partner", "item", "item_base").drop("terms"), ["lang", "other", "partner"])
    whole = whole.where(F.col("source") != F.col("item")).withColumn("value", F.col("value") + F.col("terms") * F.abs(F.col("base") - F.col("item_base")))
    # A tile with itself gives both ways already.
    other_way = whole.where(F.col("tile") < F.col("other")).select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return whole.select("lang", "source", "item", "value").unionByName(other_way)


def audit(documents: DataFrame, least_docs: int = 30, most_terms: int = 50, **sizes: int) -> DataFrame:
    """Per (lang, source): its divergence from every other source of the language (part ``pair``), and the terms it
    has more of than its language, up to ``most_terms`` of them (part ``term``)."""
    groups, kept, found = term_counts(documents, least_docs)
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")]), "divergence-totals")
    pairs = pair_divergence(groups, kept, found, **sizes)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    own = found.withColumnRenamed("total", "term_total").join(groups, ["lang", "source"])
    gap = _share(F.col("n"), F.col("total"), F.col("terms")) - _share(F.col("term_total"), F.col("lang_total"), F.col("terms"))
    terms = own.select("lang", "source", F.col("term").alias("item"), gap.alias("value")).where(F.col("value") > 0)
    pairs, terms = ranked(pairs), ranked(terms).where(F.col("rank") <= most_terms)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")
