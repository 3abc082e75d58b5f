"""N-gram Jaccard join: shingles hashed into groups, group counts as points of an R-tree, overlap bounded by summed minima.

Documents with equal sets are one class. Hashes deal sets to cells, and each cell has an R-tree over its count vectors.
A set's cells are its least hashes: of its rare shingles, and also of its common ones (those that many texts share, found
by each task's own frequent ones) if they are many. Of two sets that link, either the rare ones are alike to RARE_SHARE,
or there are that many common ones in both and those are alike to the threshold; so they share a cell: always, with
prefix=None; by default PREFIX hashes of a kind count, and the chance to miss a link is 0.2 ** PREFIX without common
shingles, and 0.35 ** PREFIX at worst. A passage that many texts share thus makes no cell of all these texts.
There are three passes:

1. Texts go to the cell of their least hash. The tree's candidates are verified there on whole sets, at once, and what
   leaves a task is a forest of links. This joins most near copies, of which nothing but one component is left.
2. Counts go to all cells that still hold several components. The tree marks the sets that have a candidate in another
   component, each pair in the one cell of its first common hash.
3. Texts of marked sets go to those cells, and are verified as in the first pass.

So pairs never leave a task, and pairs of one component aren't made. Hot cells are split into blocks: in the first pass
some pivots go to every block; then bands of sizes and blocks meet, where the largest component is not held against itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import chunks, cut, join_small, mix64, text_bytes, unit_hash, word_hashes
from .components import components, merged

#: Words of a shingle; a link has intersection * SHARE[1] >= union * SHARE[0].
WORDS, SHARE = 5, (4, 5)
#: Least hashes of a kind that deal a set to cells; groups of hashes, at least and at most: half the set's size and more within that.
PREFIX, GROUPS = 24, (64, 1024)
#: Share of the rare shingles' union that suffices to be found by them alone.
RARE_SHARE = (13, 20)
#: A shingle of more than one text in so many is common; common shingles at most (the most frequent; any choice of them gives right results).
COMMON, MOST_COMMON = 256, 1 << 17
#: Rows and shingles of a block, and from which a cell is split; pivots of a split cell; ratio of sizes in a band (above 5 / 4).
BLOCK, BLOCK_SHINGLES, PIVOTS, BAND = 1024, 1 << 22, 32, 1.26
#: Entries of a tree's node.
FAN = 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct k-word shingles, A-Z lower-cased; with fewer words the whole sequence is one."""

    def hashed(w: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(w) - n + 1, np.uint64)
        for j in range(n):
            h += mix64(w[j : len(w) - n + 1 + j] * _ODD[j % len(_ODD)] + np.uint64(j))
        return mix64(h + np.uint64(n))

    for a, b in chunks(offsets):
        words, at = word_hashes(data, offsets[a : b + 1], lower=True)
        whole = hashed(words, k) if len(words) >= k else words
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = end - begin
            x = np.sort(whole[begin : end - k + 1]) if n >= k else hashed(words[begin:end], n) if n else words[:0]
            if len(x) > 1:
                new = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=new[1:])
                x = x[new]
            yield x


def prefix_size(n: int, most: int | None = PREFIX, share: tuple[int, int] = SHARE) -> int:
    """So many least hashes of n that another set alike to `share` has one of them (and its own) in common, or `most`."""
    whole = n - -(-n * share[0] // share[1]) + 1 if n else 0
    return whole if most is None else min(most, whole)


def prefix_of(x: np.ndarray, common: np.ndarray, most: int | None = PREFIX) -> np.ndarray:
    """The hashes that deal a set (sorted hashes) to cells: rare ones, then common ones; in both by hash."""
    if not len(common) or not len(x) or not (last := common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x).any():
        return x[: prefix_size(len(x), most)]
    rare, often = x[~last], x[last]
    # not found by rare ones: I_r < r U_r, so that I_c >= s U_c + (s - r) U_r and (1 - s) n_c > (s - r) n_r
    if len(often) * (SHARE[1] - SHARE[0]) * RARE_SHARE[1] <= len(rare) * (SHARE[0] * RARE_SHARE[1] - RARE_SHARE[0] * SHARE[1]):
        often = often[:0]
    return np.concatenate([rare[: prefix_size(len(rare), most, RARE_SHARE)], often[: prefix_size(len(often), most)]])


def groups_of(n: int) -> int:
    return min(max(GROUPS[0], 1 << max(0, (n // 2 - 1).bit_length())), GROUPS[1])


def counts(hashes: np.ndarray) -> np.ndarray:
    """Hashes by group, in the smallest type that holds them."""
    groups = groups_of(len(hashes))
    found = np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    top = int(found.max(initial=0))
    return found.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


def point_of(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // groups_of(n)])


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Counts by fewer groups."""
    return points.astype(np.int64).reshape(len(points), -1, groups).sum(axis=1)


def may_link(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m with that overlap, at most, can link."""
    return overlap * (SHARE[0] + SHARE[1]) >= SHARE[0] * (n + m)


class CountTree:
    """An R-tree over count vectors, packed by size and then by the first groups. A node holds the maxima of its entries' coordinates and the range of their sizes."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray) -> None:
        order = np.lexsort((points[:, 1], points[:, 0] // 2, np.argsort(np.argsort(sizes, kind="stable")) // FAN**2)) if len(sizes) > FAN else np.arange(len(sizes))
        self.order, self.levels = order, [(points[order].astype(np.int32), sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > FAN:
            high, least, most = self.levels[-1]
            at = np.arange(0, len(high), FAN)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def query(self, size: int, point: np.ndarray) -> np.ndarray:
        """Positions of the points that may link with this one: in every node and point the sum of coordinate minima bounds the overlap."""
        at = np.arange(len(self.levels[-1][0]))
        for depth, (high, least, most) in enumerate(reversed(self.levels)):
            at = at[(most[at] * SHARE[1] >= size * SHARE[0]) & (least[at] * SHARE[0] <= size * SHARE[1])]
            at = at[may_link(np.minimum(high[at], point).sum(axis=1), np.maximum(least[at], -(-size * SHARE[0] // SHARE[1])), size)]
            if depth + 1 < len(self.levels):
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[-2 - depth][0])]
        return self.order[at]


def candidates(sizes: np.ndarray, points: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, positions) of the sets that may link with set i; each pair once, as far as sets of one width go, else from the wider set."""
    widths = np.array([len(p) for p in points])
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        tree = CountTree(sizes[own], np.stack([points[i] for i in own]))
        for i in np.flatnonzero(widths >= width).tolist():  # a set of more groups asks the trees of fewer, folded
            hit = own[tree.query(int(sizes[i]), folded(points[i][None], int(width))[0])]
            yield i, hit if widths[i] > width else hit[hit > i]


def links_among(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect sets with different labels (and sides) as far as links among them all do, verified on whole sets."""
    sizes, label, found = np.array([len(s) for s in sets]), label.copy(), []
    if len(sets) < 2 or (label == label[0]).all():
        return found
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    begin = ends - sizes
    mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
    for i, hit in candidates(sizes, [counts(s) for s in sets]):
        ok = label[hit] != label[i]
        hit = hit[ok if side is None else ok & (side[hit] != side[i])]
        if not len(hit):
            continue
        mark[ids[begin[i] : ends[i]]] = True
        overlap = np.array([np.count_nonzero(mark[ids[begin[j] : ends[j]]]) for j in hit.tolist()])
        mark[ids[begin[i] : ends[i]]] = False
        for j in hit[may_link(overlap, sizes[hit], sizes[i])].tolist():
            if label[i] != label[j]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def asking(sizes: np.ndarray, points: list[np.ndarray], label: np.ndarray, met: np.ndarray, least: list[np.ndarray], place: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Whether each set may link with one of another label (and side) whose first common hash is this cell's.

    met: pairs of the same number, but 0, were verified before. least: each set's hashes that deal it to cells; place: this cell's place among them.
    """
    out = np.zeros(len(sizes), bool)
    if (label == label[0]).all():
        return out
    width = max(map(len, least))
    table = np.zeros((len(least), width), np.int64)
    for i, x in enumerate(least):
        table[i, : len(x)] = x
    for i, hit in candidates(sizes, points):
        ok = (label[hit] != label[i]) & ((met[hit] != met[i]) | (met[i] == 0))
        hit = hit[ok if side is None else ok & (side[hit] != side[i])]
        if len(hit) and place[i]:  # not those that have an earlier hash in common
            hit = hit[~np.isin(table[hit], table[i, : place[i]]).any(axis=1)]
        if len(hit):
            out[i] = True
            out[hit] = True
    return out


def _by_cell(batches: Iterator[pa.RecordBatch], keys: int, read: Callable[[pa.RecordBatch], Iterator[tuple]]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows, ordered by their first `keys` columns, with what `read` makes of each."""
    last, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:keys]]
        for key, row in zip(zip(*columns, strict=True), read(batch), strict=True):
            if key != last:
                if held:
                    yield last, held
                last, held = key, []
            held.append(row)
    if held:
        yield last, held


_KEYS = ("h", "band", "kind", "i", "j")


def _common(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that more than one text in COMMON has: each task finds its own frequent ones, as one of them must; their counts are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def often() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= max(4, len(held) / COMMON)
            return pa.RecordBatch.from_arrays([pa.array([None, *h[some].view(np.int64).tolist()], pa.int64()), pa.array([len(held), *n[some].tolist()], pa.int64())], ["h", "n"])

        for batch in batches:
            for x in shingle_sets(*text_bytes(batch.column(0))):
                held.append(x)
                size += len(x)
                if size > 1 << 21:
                    yield often()
                    held.clear()
                    size = 0
        if held:
            yield often()

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = cut(found, "frequent")
    texts = found.filter("h is null").first()
    most = found.filter(F.col("h").isNotNull() & (F.col("n") * COMMON >= (texts["n"] if texts else 0))).orderBy(F.col("n").desc(), "h").limit(MOST_COMMON)
    return np.sort(most.select("h").toArrow().column(0).to_numpy().view(np.uint64))  # 1 MB at most


_SETS = "doc_id long, n long, s1 long, s2 long, first long, counts binary, least array<long>"


def _sets(docs: DataFrame, common: np.ndarray, prefix: int | None) -> DataFrame:
    """doc_id, n (size), s1 and s2 (hash of the set), least hash, counts and prefix of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, first, c, least = [], [], [], [], [], []
            for x in shingle_sets(*text_bytes(batch.column(1))):
                n.append(len(x))
                s1.append(int(mix64(x).sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mix64(x ^ _ODD[0]).sum(dtype=np.uint64).view(np.int64)))
                c.append(counts(x).tobytes())
                first.append(int(x[0].view(np.int64)) if len(x) else None)
                least.append(prefix_of(x, common, prefix).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(first, pa.int64()), pa.array(c, pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "n", "s1", "s2", "first", "counts", "least"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SETS)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS)


def _verified(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: _KEYS, rep, s1, part and lead, each set in the cells where it's to be compared. A forest (a, b) of the links of different parts."""
    asked = rows.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct(*_KEYS, "s1", "part", "lead")).alias("to"))
    texts = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut(asked, "asked"), "doc_id", "inner")
    spread = _dealt(texts.select("doc_id", "text", F.explode("to").alias("to")).select("to.*", "doc_id", "text").select(*_KEYS, "doc_id", "s1", "part", "lead", "text"))

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(batch.column(i).to_pylist() for i in range(5, 9)), shingle_sets(*text_bytes(batch.column(9))), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _by_cell(batches, 5, read):
            cell = {x[:2]: x for x in held if len(held) > 1 and int(mix64(x[4]).sum(dtype=np.uint64).view(np.int64)) == x[1]}  # not another text of the id
            if len(cell) > 1:
                ids, _, part, lead, sets = zip(*cell.values(), strict=True)
                links = links_among(list(sets), np.unique(part, return_inverse=True)[1], np.array(lead) if key[2] else None)
                if forest := merged([(ids[i], ids[j]) for i, j in links]):
                    a, b = zip(*forest, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cut(spread.mapInArrow(run, "a long, b long").distinct(), "links")


def _asking(rows: DataFrame) -> DataFrame:
    """rows: _KEYS, rep, s1, n, part, lead, met, counts, least. Those that have a candidate, without n and the last three columns."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(c.to_pylist() for c in batch.columns[5:]), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, held in _by_cell(batches, 5, read):
            cell = list({x[:2]: x for x in held}.values()) if len(held) > 1 else []
            if len(cell) > 1:
                _, _, n, part, lead, met, points, least = zip(*cell, strict=True)
                place = np.array([x.index(key[0]) for x in least])
                some = asking(np.array(n), [point_of(c, m) for c, m in zip(points, n, strict=True)], np.unique(part, return_inverse=True)[1], np.array(met), [np.array(x) for x in least], place, np.array(lead) if key[2] else None)
                out += [(*key, *x[:2], *x[3:5]) for x, s in zip(cell, some.tolist(), strict=True) if s]
            if len(out) > 50_000:
                yield table(out)
                out.clear()
        if out:
            yield table(out)

    kinds = [pa.int64()] * 8 + [pa.bool_()]
    names = [*_KEYS, "rep", "s1", "part", "lead"]
    table = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
    rows = _dealt(rows.select(*_KEYS, "rep", "s1", "n", "part", "lead", "met", "counts", "least"))
    return cut(rows.mapInArrow(run, ", ".join(f"{c} {'boolean' if c == 'lead' else 'long'}" for c in names)), "asking")


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))


def _key(band: Column | int, kind: int, i: Column | int, j: Column | int) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("long").alias(c) for c, x in (("band", band), ("kind", kind), ("i", i), ("j", j))])


def _hot_rows(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of hot cells at the places where they meet, with band, kind, i, j and lead.

    A row goes to its band of sizes and the next, so that rows that may link meet. At a place the rows of the cell's largest
    part (lead) are dealt to blocks, those of other parts too; every two blocks of others meet, and every block of leading
    rows meets each of them (kind 1, where only rows of different kinds are compared).
    """
    rows = join_small(rows, hot, "h", "inner")
    tops = cut(rows.groupBy("h", "part").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("part", F.struct("k", "part")).alias("top")), "tops")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND)))
    rows = join_small(rows, tops, "h", "inner").withColumn("lead", F.col("part") == F.col("top")).withColumn("band", F.explode(F.array(band, band + 1)))
    rows = cut(rows.drop("top"), "hot")
    (d, o), (dn, on) = ((F.sum(F.when(F.col("lead"), x).otherwise(0)), F.sum(F.when(F.col("lead"), 0).otherwise(x))) for x in (F.lit(1), F.col("n")))
    tally = cut(rows.groupBy("h", "band").agg(_blocks(d, dn).alias("leads"), _blocks(o, on).alias("others")).filter("others > 0"), "tally")
    rows = join_small(rows, tally, ["h", "band"], "inner")
    mine = F.pmod(F.xxhash64("rep", "s1"), F.when(F.col("lead"), F.col("leads")).otherwise(F.col("others")))
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    own = F.transform(each(F.col("others")), lambda y: _key(F.col("band"), 0, F.least(mine, y), F.greatest(mine, y)))
    across = F.transform(each(F.col("leads")), lambda y: _key(F.col("band"), 1, y, mine))
    leading = F.transform(each(F.col("others")), lambda y: _key(F.col("band"), 1, mine, y))
    keys = F.when(F.col("lead"), leading).otherwise(F.concat(own, across))
    return rows.withColumn("key", F.explode(keys)).drop("band").select("*", "key.*")


def _links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of docs' classes (rep, s1, n, first, counts, least) that connect all that links connect."""
    first = classes.select("rep", "s1", "n", F.col("first").alias("h"))
    cells = cut(first.groupBy("h").agg(F.count("*").alias("m"), _blocks(F.count("*"), F.sum("n")).alias("blocks")).filter("m > 1"), "first-cells")
    rows = join_small(first, cells, "h", "inner")
    pivot = (F.col("blocks") > 1) & (unit_hash("rep", "s1", F.lit(1)) * F.col("m") < PIVOTS)
    block = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep", "s1"), "blocks")))
    rows = rows.select("h", F.lit(0).cast("long").alias("band"), F.lit(0).cast("long").alias("kind"), F.explode(block).alias("i"), F.lit(0).cast("long").alias("j"), "rep", "s1", F.xxhash64("rep", "s1").alias("part"), F.lit(False).alias("lead"))
    links = _verified(docs, rows)

    known = cut(components(links).select(F.col("node").alias("rep"), "component"), "parts")
    parted = join_small(classes.select("rep", "s1", "n", "first", "counts", "least"), known, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    posted = parted.select("rep", "s1", "part", F.explode("least").alias("h"))
    mixed = cut(posted.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("h"), "mixed")
    met = join_small(posted.select("rep", "s1", "h"), mixed, "h", "inner")
    split = cells.filter("blocks > 1").select(F.col("h").alias("first"), F.lit(True).alias("split"))
    rows = join_small(parted, cut(met.groupBy("rep", "s1").agg(F.collect_list("h").alias("hs")), "met"), ["rep", "s1"], "inner").withColumn("h", F.explode("hs")).drop("hs")
    rows = join_small(rows, split, "first", "left").withColumn("met", F.when(F.col("split").isNull(), F.col("first")).otherwise(0)).drop("split", "first")
    rows = cut(rows, "cells")
    hot = cut(rows.groupBy("h").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks")).filter("blocks > 1").select("h"), "hot")
    cold = join_small(rows, hot, "h", "left_anti").withColumn("lead", F.lit(False)).select("*", _key(0, 0, 0, 0).alias("key")).select("*", "key.*").drop("key")
    if not hot.isEmpty():
        cold = cold.unionByName(_hot_rows(rows, hot).select(cold.columns))
    return links.unionByName(_verified(docs, _asking(cold)))


def joined(docs: DataFrame, prefix: int | None = PREFIX) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles and component_id, a row for each row.

    Two documents link if 100 * intersection >= 80 * union of their sets of distinct 5-word shingles. A null, empty or
    blank text has no shingles and no links. component_id: least doc_id that links reach, itself included. Rows that
    repeat an id are one node. A row with a null id links with nothing; its component is null. prefix: least hashes of a
    kind that lead to candidates, at most; None for as many as no link can be missed with. More columns play no part.
    """
    rows = cut(_sets(docs, _common(docs), prefix), "sets")
    usable = rows.filter("n > 0 and doc_id is not null")
    classes = usable.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("first", "counts", "least")])
    classes = cut(classes, "classes")
    links = _links(docs, classes)

    member = usable.select("doc_id", "n", "s1", "s2")
    again = member.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    again = cut(again, "again")
    if not again.isEmpty():  # ids with several texts tie their classes together
        several = join_small(member, again, "doc_id", "inner").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        links = links.unionByName(several)
    known = components(links).select(F.col("node").alias("rep"), "component")
    known = cut(classes.select("n", "s1", "s2", "rep").join(known, "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id")), "known")
    out = join_small(rows.select("doc_id", "n", "s1", "s2"), known, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the documents whose component has one with a smaller doc_id; of rows that repeat a doc_id, one stays. Rows with a null id stay."""
    found = joined(docs)
    gone = cut(found.filter("doc_id > component_id").select("doc_id").distinct(), "gone")
    kept = join_small(docs, gone, "doc_id", "left_anti")
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    if not again.isEmpty():
        again = cut(again, "repeated")
        kept = join_small(kept, again, "doc_id", "left_anti").unionByName(join_small(kept, again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept
