"""Exact n-gram Jaccard join as a metric-space join.

1 - J is a metric on sets, so the join works with pivots, Voronoi regions and the triangle inequality. Word sets are so
sparse that almost all pairs have the distance 1; general pivots would tell nothing. Pivots are therefore documents
that share a rare shingle with others. In short:

* Rows with equal shingle sets are one class; classes are the nodes from there on.
* Shingles are ordered, rare ones first: those that occur once go before those that occur more often, and these before
  frequent ones, with ties by hash. Two sets with J >= t share a shingle among the first n - ceil(t n) + 1 of each.
  Everything that has a given shingle there lies in one region; the smallest class of it is the pivot. So linked
  classes always meet in a region, and a text that is mostly its own lies in none. Occurrences are counted in a third
  of the hash space, beyond it common shingles are told by their recurrence in a batch, and bitmaps of fixed size hold
  both: any fixed order is right, a better one only prunes more.
* First round: a class belongs to the Voronoi cell of the pivot that it shares most shingles with; its distance to that
  pivot gives a link or not. Links are merged to components.
* Second round: only regions that are still in several components go on. What isn't in a region's largest component
  is compared with all of the region. Spark parts a large region into the Voronoi cells of pivots from some of its
  components; along from other cells go members in the window d(y, pivot) <= d(y, own pivot) + 2 (1 - t), and every
  cell is a region of the next round. Small regions, and those that pivots don't part, are joined in blocks; a block
  does the same within itself, down to direct comparison. Pairs that are connected already need none.

Every link between different sets is found or lies inside a component, so components are exact. Hashes are 64 bits a
shingle and 128 bits a class.

Defined cases: null, empty and white-space texts have empty sets, which link with nothing; texts of fewer words than a
shingle are one shingle; texts may be of any length; an empty table gives an empty result; rows that repeat a doc_id with other texts are judged each by its own text; a null doc_id links
but never names a component while another id is there; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, SPACE, bitmap, components, in_bitmap, join_hot, list_array, map_arrow, map_groups, mix, text_bytes, window_hashes, word_hashes, word_spans
from weftline.storage import discard, fresh, materialize

_LOW = np.uint64((1 << 64) // 3)  # hashes below this are counted: more than a prefix for t = 0.8 has
_SALT = np.uint64(0xA24BAED4963EE407)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: `size` words of `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, SPACE)
    words = word_hashes(data, starts, ends)
    windows = window_hashes(words, size)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def class_ids(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits for each set."""
    out = []
    for s in sets:
        a, b = mix(s + _SALT).sum(dtype=np.uint64), mix(s ^ _SALT).sum(dtype=np.uint64) + np.uint64(len(s))
        out.append(np.array([a, b]).tobytes())
    return out


def _binary16(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _slices(column: pa.Array, rows: int = 512) -> Iterator[pa.Array]:
    for at in range(0, len(column), rows):
        yield column.slice(at, rows)


def prefix_length(n: int, percent: int) -> int:
    """Of two sets with 100 |A & B| >= percent |A | B|, each has one of its first so many shingles in common."""
    return n + 1 - -(-percent * n // 100)


def _counted(size: int):
    """Shingles to count: all below _LOW, and above it those that several texts of the batch have, i.e. common ones."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), size)
        cuts = [int(np.searchsorted(s, _LOW)) for s in sets]
        high, times = np.unique(np.concatenate([s[c:] for s, c in zip(sets, cuts, strict=True)]), return_counts=True)
        common = np.repeat(high[times > 1], times[times > 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*[s[:c] for s, c in zip(sets, cuts, strict=True)], common]).view(np.int64))], names=["s"])

    return fn


def _signed(size: int, percent: int, shared):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        often, frequent = shared.value
        sets, hits = shingle_sets(batch.column("text"), size), []
        for s in sets:
            cut = int(np.searchsorted(s, _LOW))
            level = np.zeros(len(s), np.int8)
            level[:cut] = in_bitmap(often, s[:cut])
            maybe = np.flatnonzero((level > 0) | (s >= _LOW))
            level[maybe[in_bitmap(frequent, s[maybe])]] = 2
            order = np.argsort(level, kind="stable")[: prefix_length(len(s), percent)] if len(s) else np.zeros(0, np.int64)
            first = s[order]
            hits.append(first[(first >= _LOW) | (level[order] > 0)])
        offsets = np.cumsum([0, *[len(h) for h in hits]])
        values = pa.array(np.concatenate([*hits, np.zeros(0, np.uint64)]).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), _binary16(class_ids(sets)), pa.array([len(s) for s in sets], pa.int64()), list_array(offsets, values)], names=["doc_id", "c", "n", "hits"])

    return fn


def _sets(size: int, shared):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = shingle_sets(batch.column("text"), size)
        ids = class_ids(sets)
        keys = _row_keys(batch.column("doc_id"), ids)
        keep = np.flatnonzero(in_bitmap(shared.value, keys) & np.array([len(s) > 0 for s in sets], bool))
        kept = [sets[i] for i in keep]
        offsets = np.cumsum([0, *[len(s) for s in kept]])
        values = pa.array(np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64))
        return pa.RecordBatch.from_arrays([_binary16([ids[i] for i in keep]), list_array(offsets, values)], names=["c", "items"])

    return fn


def _row_keys(doc_ids: pa.Array, ids: list[bytes]) -> np.ndarray:
    """A hash of doc_id and class; as ``_row_key`` in SQL."""
    halves = np.frombuffer(b"".join(ids), np.uint64).reshape(-1, 2)
    numbers = doc_ids.cast(pa.int64()).fill_null(-1).to_numpy().view(np.uint64)
    return mix(mix(numbers) ^ halves[:, 0])


# ---------------------------------------------------------------- regions


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Region:
    """Members of a block of a region, and what links them."""

    def __init__(self, lists: pa.ListArray, percent: int):
        self.offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]
        found, self.items = np.unique(values, return_inverse=True)
        self.sizes = np.diff(self.offsets)
        self.mark = np.zeros(len(found), bool)
        self.percent, self.union = percent, _Union(len(self.sizes))
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.compared = 0

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x with others."""
        own = self.items[self.offsets[x] : self.offsets[x + 1]]
        self.mark[own] = True
        if len(others) * 4 < len(self.sizes):
            parts = [int(self.mark[self.items[self.offsets[o] : self.offsets[o + 1]]].sum()) for o in others]
            out = np.array(parts, np.int64)
        else:
            out = np.bincount(self.owner[self.mark[self.items]], minlength=len(self.sizes))[others]
        self.mark[own] = False
        self.compared += len(others)
        return out

    def distances(self, x: int, others: np.ndarray) -> np.ndarray:
        both = self.shared(x, others)
        linked = 100 * both >= self.percent * (self.sizes[x] + self.sizes[others] - both)
        for o in others[linked].tolist():
            self.union.join(x, o)
        return 1 - both / (self.sizes[x] + self.sizes[others] - both)

    def join(self, left: np.ndarray, right: np.ndarray, pivots: int = 6, leaf: int = 24) -> None:
        """Link every linked pair of a member of ``left`` with one of ``right`` (which may overlap), if it isn't
        connected already."""
        if min(len(left), len(right)) <= leaf:
            few, many = (left, right) if len(left) <= len(right) else (right, left)
            for x in few.tolist():
                # Sizes alone rule out what is too short or too long, components what is connected.
                n = self.sizes[many]
                open_ = many[(100 * np.minimum(n, self.sizes[x]) >= self.percent * np.maximum(n, self.sizes[x])) & (many != x)]
                root = self.union.find(x)
                open_ = np.array([o for o in open_.tolist() if self.union.find(o) != root], np.int64)
                if len(open_):
                    self.distances(x, open_)
            return
        # Two far members at a time: each next pivot is the member farthest from those before.
        chosen, dl, dr = [int(left[0])], [], []
        while True:
            dl.append(self.distances(chosen[-1], left))
            dr.append(self.distances(chosen[-1], right))
            if len(chosen) == pivots:
                break
            chosen.append(int(left[np.min(dl, 0).argmax()]))
        dl, dr = np.array(dl), np.array(dr)
        slack, home = 2 * (1 - self.percent / 100) + 1e-9, dl.argmin(0)
        for i in range(pivots):
            cell = left[home == i]
            near = right[dr[i] <= dr.min(0) + slack]
            # The window: what is linked with a member of the cell is as near to its pivot as the member, give or take 1 - t.
            if len(cell):
                reach = dl[i][home == i]
                near = near[(dr[i][dr[i] <= dr.min(0) + slack] >= reach.min() - slack / 2) & (dr[i][dr[i] <= dr.min(0) + slack] <= reach.max() + slack / 2)]
            if len(cell) and len(near):
                if len(cell) + len(near) > 0.9 * (len(left) + len(right)):
                    self.join(cell, near, pivots, len(cell))  # the pivots told nothing: compare directly
                else:
                    self.join(cell, near, pivots, leaf)


def _link(percent: int):
    """Edges of a block: members of role 2 are compared with those of role 1; a member can have both (3)."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if batch.num_rows < 2:
            return None
        ids = batch.column("c").to_pylist()
        first = {}
        index = np.array([first.setdefault(c, i) for i, c in enumerate(ids)])  # several rows can have the set of a class
        region = Region(batch.column("items"), percent)
        role = batch.column("role").to_numpy()
        left, right = np.unique(index[role & 2 > 0]), np.unique(index[role & 1 > 0])
        if not len(left) or not len(right):
            return None
        region.join(left, right)
        pairs = [(ids[i], ids[r]) for i in np.unique(index).tolist() if (r := region.union.find(i)) != i]
        return pa.RecordBatch.from_arrays([_binary16([a for a, _ in pairs]), _binary16([b for _, b in pairs])], names=["a", "b"]) if pairs else None

    return fn


def _joined(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """blocks: (g, c, role). Edges found in all blocks."""
    rows = blocks.groupBy("g", "c").agg(F.bit_or("role").alias("role")).join(sets, "c").select("g", "c", "role", "items")
    return map_groups(rows, "g", _link(percent), "a binary, b binary")


def _cells(percent: int):
    """Members of a block of a region and its pivots (role 4): a row (r, cell, c, role) for every cell that a member goes
    to, and links of members and pivots (a, b)."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        role = batch.column("role").to_numpy()
        pivots, members = np.flatnonzero(role & 4), np.flatnonzero(role & 3)
        if not len(pivots) or not len(members):
            return None
        ids, region = batch.column("c").to_pylist(), Region(batch.column("items"), percent)
        distance, links = [], []
        for p in pivots.tolist():
            both = region.shared(p, members)
            all_ = region.sizes[p] + region.sizes[members] - both
            distance.append(1 - both / all_)
            links += [(ids[m], ids[p]) for m in members[100 * both >= percent * all_].tolist() if ids[m] != ids[p]]
        distance = np.array(distance)
        # What is linked with a member is as near to the member's nearest pivot as to its own, give or take 2 (1 - t).
        near = distance <= distance.min(0) + 2 * (1 - percent / 100) + 1e-9
        home = distance.argmin(0)
        cell, at = np.nonzero(near)
        roles = (role[members[at]] & 1) + np.where((role[members[at]] & 2 > 0) & (home[at] == cell), 2, 0)
        keep = roles > 0
        cells, rows, roles = cell[keep], members[at[keep]], roles[keep]
        n = len(links)
        columns = [pa.array(np.concatenate([np.full(len(cells), batch.column("r")[0].as_py()), np.zeros(n, np.int64)])), pa.array([ids[pivots[x]] for x in cells] + [b for _, b in links], pa.binary()), pa.array([ids[x] for x in rows] + [a for a, _ in links], pa.binary()), pa.array(np.concatenate([roles, np.full(n, 8)]).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["r", "cell", "c", "role"])

    return fn


def _joined_regions(mixed: DataFrame, sets: DataFrame, percent: int, block: int, pivots: int = 12, most: int = 16) -> DataFrame:
    """Edges (a, b) that connect every linked pair of a member of role 2 of a region with one of role 1.

    mixed: (r, c, label, role) of regions r; a member can have both roles (3). Small regions are compared directly, in blocks; a large one
    is parted into the cells of its pivots, one each of some of its components, and every cell is a region of the next
    round. A cell that is hardly smaller than its region told nothing, and is compared directly.
    """
    found, direct, current, before = [], [], mixed, None
    while True:
        regions = current.groupBy("r").agg(F.sum((F.col("role").bitwiseAND(1) > 0).cast("long")).alias("all"), F.sum((F.col("role").bitwiseAND(2) > 0).cast("long")).alias("left"), F.count("*").alias("n"), F.max("parent").alias("parent"))
        regions = regions.where("left > 0 and all > 1").select("r", "n", "all", F.ceil(F.col("all") / block).alias("cores"), F.ceil(F.col("left") / block).alias("lefts"), "parent")
        regions = materialize(regions, "region-sizes")
        large = (F.col("cores") * F.col("lefts") > most) & (F.col("all") <= 0.75 * F.col("parent"))
        direct.append((current, regions.where(~large)))
        split = regions.where(large)
        if split.isEmpty():
            break
        split = split.select("r", "n", "all", F.ceil(F.col("n") / block).alias("chunks"))
        members = materialize(join_hot(current.drop("parent"), split, ["r"], lambda d: d.select("r", "c", "label", "role", "all", "chunks", F.pmod(F.xxhash64("c", F.lit(3)), "chunks").alias("chunk"))), "members")
        # One member each of components, dealt by hash; of those with a hash the largest.
        part = members.groupBy("r", "chunks", F.pmod(F.xxhash64("label"), F.lit(pivots)).alias("h"), "label").agg(F.count("*").alias("m"), F.min("c").alias("c"))
        chosen = part.groupBy("r", "chunks", "h").agg(F.max_by("c", F.struct("m", "c")).alias("c"))
        each = chosen.select("r", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(4).alias("role"))
        blocks = members.select("r", "c", "chunk", "role").unionByName(each).groupBy("r", "chunk", "c").agg(F.bit_or("role").alias("role"))
        rows = blocks.join(sets, "c").select(F.xxhash64("r", "chunk").alias("g"), "r", "c", "role", "items")
        cells = materialize(map_groups(rows, "g", _cells(percent), "r long, cell binary, c binary, role int"), "cells")
        found.append(cells.where("role = 8").select(F.col("c").alias("a"), F.col("cell").alias("b")))
        cells = cells.where("role < 8").groupBy(F.col("r").alias("up"), "cell", "c").agg(F.bit_or("role").alias("role"))
        sizes = split.select(F.col("r").alias("up"), F.col("all").alias("parent"))
        labels = members.groupBy(F.col("r").alias("up"), "c").agg(F.min("label").alias("label"))
        current = materialize(cells.join(labels, ["up", "c"]).join(sizes, "up").select(F.xxhash64("up", "cell").alias("r"), "c", "label", "role", "parent"), "regions")
    for rows, regions in direct:
        placed = join_hot(rows.drop("parent"), regions.drop("parent"), ["r"], lambda d: d.select("r", "c", "role", "cores", "lefts", F.pmod(F.xxhash64("c", F.lit(1)), "cores").alias("i"), F.pmod(F.xxhash64("c", F.lit(2)), "lefts").alias("j")))
        placed = materialize(placed, "mixed")
        to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        core = placed.where(F.col("role").bitwiseAND(1) > 0).select("r", "c", "i", F.explode(to("lefts")).alias("j"), F.lit(1).alias("role"))
        left = placed.where(F.col("role").bitwiseAND(2) > 0).select("r", "c", F.explode(to("cores")).alias("i"), "j", F.lit(2).alias("role"))
        found.append(materialize(_joined(core.unionByName(left).select(F.xxhash64("r", "i", "j").alias("g"), "c", "role"), sets, percent), "links"))
    return reduce(DataFrame.unionByName, found)


def links(documents: DataFrame, size: int = 5, percent: int = 80, block: int = 128) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, classes, labels): signed has doc_id, class c and set size n of every row, classes the smallest doc_id of
    each class, labels a component label for every class that is linked with another."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    # How often shingles occur: those of a quarter of the hash space, where the prefixes lie.
    counted = map_arrow(texts.select("text"), _counted(size), "s long", 256).groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    counted = materialize(counted, "shared-shingles")
    low = F.col("s").between(0, int(_LOW) - 1)  # as a signed number: below a third of the hash space
    often = bitmap(counted.where(low), "s", 27)
    frequent = bitmap(counted.where(F.when(low, F.col("n") >= 8).otherwise(F.lit(True))), "s", 25)
    shared = spark.sparkContext.broadcast((often, frequent))
    signed = materialize(map_arrow(texts, _signed(size, percent, shared), "doc_id long, c binary, n long, hits array<long>", 256), "signed")
    shared.destroy()
    del often, frequent
    classes = materialize(signed.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    # The hits of one row of each class.
    hits = signed.where(F.size("hits") > 0).join(classes.select("c", "rep"), "c").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    hits = materialize(hits.select("c", F.explode("hits").alias("s")).distinct(), "hits")
    pivots = materialize(hits.groupBy("s").agg(F.min("c").alias("p"), F.count("*").alias("n")).where("n > 1"), "pivots")
    members = materialize(join_hot(hits, pivots, ["s"], lambda d: d.select("p", "c")).groupBy("p", "c").agg(F.count("*").alias("votes")), "regions")
    discard(hits, pivots)
    if members.isEmpty():
        return signed, classes, members.select(F.col("c").alias("node"), F.col("p").alias("label"))
    # Sets of the classes that are in a region, from one row each as far as a bitmap can tell.
    wanted = members.select("c").distinct().join(classes, "c").select(F.col("rep").alias("doc_id"), "c")

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_row_keys(batch.column("doc_id"), batch.column("c").to_pylist()).view(np.int64))], names=["k"])

    chosen = spark.sparkContext.broadcast(bitmap(map_arrow(wanted, keys, "k long", 1 << 16), "k"))
    sets = materialize(map_arrow(texts, _sets(size, chosen), "c binary, items array<long>", 256), "sets")

    chosen.destroy()

    # First round: each class and the pivot that it shares most shingles with, if sizes allow a link.
    sizes = classes.select("c", "n")
    members = members.join(sizes, "c").join(sizes.select(F.col("c").alias("p"), F.col("n").alias("pn")), "p")
    members = materialize(members, "regions")
    alike = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    cell = members.where("p <> c").where(alike).groupBy("c").agg(F.max_by("p", F.struct("votes", "p")).alias("p"))
    cell = materialize(cell.withColumn("chunk", F.pmod(F.xxhash64("c"), F.lit(1 << 20))), "cells")
    chunks = cell.groupBy("p").agg(F.ceil(F.count("*") / block).alias("chunks"))
    placed = cell.join(chunks, "p").select("p", "c", (F.col("chunk") % F.col("chunks")).alias("chunk"))
    group = F.xxhash64("p", "chunk")
    blocks = placed.select(group.alias("g"), "c", F.lit(1).alias("role")).unionByName(placed.select(group.alias("g"), F.col("p").alias("c"), F.lit(2).alias("role")).distinct())
    edges = materialize(_joined(blocks, sets, percent), "links")
    labels = components(edges)

    # Second round: parts of regions that are in several components. Sizes of linked sets differ by 1 / t at most (the
    # triangle inequality with the empty set), so a part holds the sizes of a band and of the next.
    band = F.floor(F.log("n") / max(float(np.log(100 / percent)) * 1.001, 1e-9))
    named = members.select("p", "c", band.alias("band")).join(labels.withColumnRenamed("node", "c"), "c", "left")
    named = named.select("p", "c", F.coalesce("label", "c").alias("label"), "band", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("k"))
    named = materialize(named, "named")
    parts = named.groupBy("p", "k", "label").agg(F.count("*").alias("m"), F.max(F.col("band") == F.col("k")).alias("own"))
    most = parts.groupBy("p", "k").agg(F.max(F.struct("m", "label")).alias("most"), F.sum("m").alias("n"), F.count("*").alias("labels"), F.max("own").alias("own")).where("labels > 1 and own")
    most = materialize(most.select("p", "k", F.col("most.label").alias("main"), "n"), "mixed-regions")
    mixed = join_hot(named, most, ["p", "k"], lambda d: d.select(F.xxhash64("p", "k").alias("r"), "c", "label", F.when(F.col("label") != F.col("main"), 3).otherwise(1).alias("role")))
    mixed = materialize(mixed.withColumn("parent", F.lit(1 << 62)), "mixed")
    more = _joined_regions(mixed, sets, percent, block)
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    return signed, classes, labels


def report(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    signed, classes, labels = links(documents, size, percent)
    named = classes.select("c", "rep").join(labels.withColumnRenamed("node", "c"), "c", "left").select("c", "rep", F.coalesce("label", "c").alias("label"))
    named = materialize(named, "classes")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("c", "component_id")
    return signed.select("doc_id", "c", "n").join(named, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all columns. Rows that repeat
    a doc_id are one document and stay or go together. Documents that link with nothing stay."""
    name = fresh("kept_id", documents)
    found = report(documents, size, percent).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
