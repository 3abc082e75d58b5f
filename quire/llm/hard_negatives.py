"""Hard negatives by pruned coordinate lists (after LEMP): length buckets, feasible ranges of focus coordinates, exact verification.

Rows become integer vectors, are ordered by length and packed into buckets of narrow length ranges; a bucket has, for each
coordinate, its rows in the order of that coordinate of their unit vectors. An anchor that needs a score of at least t asks a
bucket of length l only if t / (|anchor| l) is a possible cosine, and then only the rows whose coordinates, at the anchor's few
largest ones, lie in the range that this cosine leaves open: every row with such a score does. Rows in all of these ranges are
verified by their integer product. A task holds a group of buckets and streams all blocks of
anchors against it; it keeps k rows for each list asked for, and what it needs rises as the lists fill. Lists are merged FAN
groups at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import cut
from .search import _LONG, _matrix, products, valid

#: Rows of a bucket, bytes of the buckets of a group, anchors of a block, groups merged at a time, focus coordinates of an anchor.
ROWS, GROUP_BYTES, BLOCK, FAN, FOCUS = 4096, 32 << 20, 512, 16, 4
#: What rounding may take from a cosine or a coordinate.
SLACK = 1e-6
_BUCKET = "dim int, bucket long, width int, data binary, ids binary, labels binary, orders binary"
_ASK = "dim int, ids binary, labels binary, data binary, lows array<array<long>>, highs array<array<long>>"


def _integers(vectors: list) -> np.ndarray:
    """floor(256 x) as long; beyond its range, the nearest long."""
    x = np.floor(256.0 * np.asarray(vectors, float))
    return np.where(x >= 2.0**63, _LONG.max, np.where(x < -(2.0**63), _LONG.min, np.clip(x, -(2.0**63), 2.0**63 - 1024)).astype(np.int64)).astype(np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(axis=1))


def buckets(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, embedding, all valid) as buckets of up to ROWS rows of like length, of one dimension each, in order of vec_id, with their coordinate lists."""

    def flush(dim: int, first: int, found: list[tuple]) -> pa.RecordBatch:
        found.sort(key=lambda r: r[0])
        data = _integers([r[2] for r in found])
        top = int(np.abs(data.astype(float)).max())
        kind = next((k for k in (np.int16, np.int32) if top < np.iinfo(k).max), np.int64)
        orders = np.argsort(_units(data), axis=0, kind="stable").T.astype(np.int16)
        values = dim, first, np.dtype(kind).itemsize, data.astype(kind).tobytes(), *(np.array([r[k] for r in found], np.int64).tobytes() for k in (0, 1)), orders.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["dim", "bucket", "width", "data", "ids", "labels", "orders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list]] = {}
        for batch in batches:
            for vec_id, label, x, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, found = held.setdefault(len(x), (pos, []))
                found.append((vec_id, label, x))
                if len(found) == ROWS:
                    yield flush(len(x), first, found)
                    del held[len(x)]
        for dim, (first, found) in held.items():
            yield flush(dim, first, found)

    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 256).cast("double"), F.lit(2))).alias("length")
    x = rows.select("vec_id", "label", "embedding", length).repartitionByRange(F.col("length"), F.col("vec_id")).sortWithinPartitions("length", "vec_id")
    return x.select("vec_id", "label", "embedding", F.monotonically_increasing_id().alias("pos")).mapInArrow(run, _BUCKET)


def _units(x: np.ndarray) -> np.ndarray:
    lengths = _lengths(x)
    return x.astype(float) / np.where(lengths > 0, lengths, 1)[:, None]


class Lists:
    """The k best scores so far of each (anchor, list), and what a new one needs. lows and highs: the range of scores of each list."""

    def __init__(self, lows: list[list[int]], highs: list[list[int]], k: int) -> None:
        self.lows, self.highs, self.k = lows, highs, k
        self.best: list[list[list[tuple[int, int]]]] = [[[] for _ in x] for x in lows]

    def needs(self) -> np.ndarray:
        """The least score that still counts, for each anchor; infinite if none does."""
        return np.array([min((self._need(i, j) for j in range(len(x))), default=np.inf) for i, x in enumerate(self.lows)], float)

    def _need(self, i: int, j: int) -> int:
        full = self.best[i][j]
        return max(self.lows[i][j], -full[-1][0]) if len(full) == self.k else self.lows[i][j]

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        for j, found in enumerate(self.best[i]):
            fits = np.flatnonzero((scores >= self._need(i, j)) & (scores <= self.highs[i][j]))
            if len(fits) > 4 * self.k:  # the k-th best of them and its ties
                least = np.partition(scores[fits], len(fits) - self.k)[len(fits) - self.k]
                fits = fits[scores[fits] >= least]
            if len(fits):
                fits = fits[np.lexsort((ids[fits], -scores[fits]))][: self.k]  # scores are at least -2^63 + 1
                self.best[i][j] = sorted([*found, *zip((-scores[fits]).tolist(), ids[fits].tolist(), strict=True)])[: self.k]


def candidates(q: np.ndarray, unit: np.ndarray, needs: np.ndarray, longest: float, units: np.ndarray, orders: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each anchor (row of q, unit) that may reach its need in a bucket, the rows that its focus coordinates leave."""
    lengths = _lengths(q)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(needs <= 0, np.where(needs == 0, 0.0, -1.0), needs / (lengths * longest))  # a row shorter than the longest needs a larger cosine, or, below zero, any
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    for i in np.flatnonzero(least <= 1 + SLACK):
        t = min(least[i], 1.0)
        if t < 0:
            yield i, np.arange(len(units))
            continue
        ranges = []
        for f in focus[i]:
            mid, half = unit[i, f] * t, np.sqrt(max(0.0, 1 - unit[i, f] ** 2) * (1 - t * t))
            low, high = mid - half, (1.0 if t <= unit[i, f] else mid + half)  # of all vectors with a cosine of t or more
            low = -1.0 if t <= -unit[i, f] else low
            column = units[orders[f], f]
            a, b = np.searchsorted(column, low - SLACK, "left"), np.searchsorted(column, high + SLACK, "right")
            ranges.append((b - a, f, a, b, low - SLACK, high + SLACK))
        _, f, a, b, *_ = min(ranges)
        rows = orders[f, a:b]
        for _, g, _, _, low, high in ranges:
            if g != f and len(rows):
                x = units[rows, g]
                rows = rows[(x >= low) & (x <= high)]
        yield i, rows


def search(packed: DataFrame, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """For each list j (low..high) of each anchor, the k best rows of the same label, or of different ones: anchor_id, list, vec_id, score, rank.

    packed: of buckets(), as a table. asks: (vec_id, label, embedding, lows, highs). Rows with the anchor's own id are left out.
    """
    count, size = packed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("data") + F.octet_length("orders")), F.lit(0))).first()
    groups = max(1, min(count, max(-(-size // GROUP_BYTES), packed.sparkSession.sparkContext.defaultParallelism)))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        kinds = [pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.list_(pa.int64()))] * 2]

        def flush(dim: int) -> pa.RecordBatch:
            found = held.pop(dim)
            values = dim, *(np.array([r[c] for r in found], np.int64).tobytes() for c in (0, 1)), _integers([r[2] for r in found]).tobytes(), *([r[c] for r in found] for c in (3, 4))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["dim", "ids", "labels", "data", "lows", "highs"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(len(r[2]), []).append(r)
                if len(held[len(r[2])]) == BLOCK:
                    yield flush(len(r[2]))
        for dim in list(held):
            yield flush(dim)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for x in (dict(zip(batch.schema.names, v, strict=True)) for batch in batches for i in range(batch.num_rows) for v in zip(*(c.to_pylist() for c in batch.slice(i, 1).columns), strict=True)):
            if x["g"] != group:
                group, held = x["g"], []
            ids, labels = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64)
            data = _matrix(x["data"], x["width"], x["dim"])
            if x["side"] == 0:  # the group's buckets come first, the longest rows' first of all
                held.append((ids, labels, data, _units(data), np.frombuffer(x["orders"], np.int16).reshape(x["dim"], -1), float(_lengths(data).max())))
                continue
            unit, lists = _units(data), Lists(x["lows"], x["highs"], k)
            for of, tags, rows, units, orders, longest in held:
                if rows.shape[1] != x["dim"]:
                    continue
                asked = list(candidates(data, unit, lists.needs(), longest, units, orders))
                wide = [i for i, left in asked if 4 * len(left) > len(of)]  # verified in one product
                scores = dict(zip(wide, products(data[wide], rows), strict=True)) if wide else {}
                for i, left in asked:
                    left = left[((tags[left] == labels[i]) == same) & (of[left] != ids[i])]
                    if len(left):
                        found = scores[i][left] if i in scores else products(data[i : i + 1], rows[left])[0]
                        lists.add(i, of[left], np.maximum(found, _LONG.min + 1))
            out = [(group, ids[i], j, v, -s) for i, best in enumerate(lists.best) for j, found in enumerate(best) for s, v in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["branch", "anchor_id", "list", "vec_id", "score"])

    blocks = asks.select("vec_id", "label", "embedding", "lows", "highs").mapInArrow(block, _ASK)
    none = F.lit(None).cast("array<array<long>>")
    rows = packed.select(F.pmod(F.xxhash64("bucket", "dim"), F.lit(groups)).alias("g"), F.lit(0).alias("side"), "bucket", "dim", "ids", "labels", "width", "data", "orders", none.alias("lows"), none.alias("highs"))
    each = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("bucket"), "dim", "ids", "labels", F.lit(8).alias("width"), "data", F.lit(None).cast("binary").alias("orders"), "lows", "highs")
    tops = rows.unionByName(each).repartition("g").sortWithinPartitions("g", "side", F.desc("bucket")).mapInArrow(tiles, "branch long, anchor_id long, list long, vec_id long, score long")
    while True:
        final, groups = groups == 1, -(-groups // FAN)
        tops = tops.withColumn("branch", F.floor(F.col("branch") / FAN))
        window = Window.partitionBy("anchor_id", "list", *([] if groups == 1 else ["branch"])).orderBy(F.col("score").desc(), "vec_id")
        tops = tops.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
        if final or groups == 1:
            return tops.select("anchor_id", "list", "vec_id", "score", "rank")
        tops = tops.drop("rank")


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """rows (vec_id, label, embedding) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors. A score is the inner product of floor(256 x), higher first, ties to the smaller vec_id. A
    positive is one of an anchor's best other rows of its label; its negatives are the best rows of other labels whose scores s
    satisfy share * positive_score <= 100 s <= 100 * positive_score: none if the positive score is below zero. Rows with a null
    id or label, and vectors that are null, empty or not finite take no part; vectors of unlike lengths have no score. An anchor
    id that occurs more than once asks once, with its least vector; other repeated rows count each, but never against their own
    id. Extra columns are left out; no rows or anchors give no rows. Scores beyond the range of a long are the nearest long.
    """
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid("embedding")
    x = rows.filter(usable).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    packed = cut(buckets(x), "buckets")
    asked = cut(x.filter(anchors).groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("x")).select("vec_id", "x.label", "x.embedding"), "anchors")
    every = lambda v: F.array(F.lit(v).cast("long")).alias
    best = cut(search(packed, asked.select("*", every(int(_LONG.min))("lows"), every(int(_LONG.max))("highs")), positives, True), "positives")
    product = F.col("score").cast("decimal(38,0)") * share
    low = (-F.floor(-product / 100)).cast("long")
    wanted = best.filter("score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), F.col("score").alias("high"), F.col("vec_id").alias("positive_id")))).alias("p"))
    wanted = cut(wanted, "wanted")
    asks = asked.join(wanted, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "embedding", F.col("p.low").alias("lows"), F.col("p.high").alias("highs"))
    found = search(packed, asks, negatives, False)
    listed = wanted.select("anchor_id", F.posexplode("p").alias("list", "p")).select("anchor_id", F.col("list").cast("long").alias("list"), "p.positive_id", F.col("p.high").alias("positive_score"))
    return found.join(listed, ["anchor_id", "list"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
