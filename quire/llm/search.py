"""Exact top-k search by inner product: tiles of queries and shards, partial selection per tile, a tree of merges.

Rows become matrix blocks where they lie. Blocks of rows are dealt to groups, every block of queries goes to every group,
and a task multiplies the pairs of blocks of its groups, keeping the best k of each query only. Lists are then merged
FAN groups at a time, until one list per query is left; a merge never holds more than FAN * k rows of a query and level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import cut

#: Rows per block, bytes of the rows of a group, groups merged at a time, query blocks whose lists a task holds.
ROWS, GROUP_BYTES, FAN, HELD = 2048, 64 << 20, 16, 64
_LONG = np.iinfo(np.int64)


def valid(column: str):
    """Vectors that take part: not null or empty, all components finite."""
    c = F.col(column)
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def blocks(vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """vectors (vec_id long, embedding) as blocks (dim, n, ids, data) of one dimension each: floor(256 x) as long, by vec_id within a block.

    A component beyond the range of a long is the nearest long.
    """

    def flush(ids: list[int], vectors: list[np.ndarray], dim: int) -> tuple:
        scaled = np.floor(256.0 * np.stack(vectors).astype(float))
        data = np.where(scaled >= 2.0**63, _LONG.max, np.where(scaled < -(2.0**63), _LONG.min, np.clip(scaled, -(2.0**63), 2.0**63 - 1024)).astype(np.int64)).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        data = data[order]
        kind = next((k for k in (np.int16, np.int32) if np.abs(scaled).max() < np.iinfo(k).max), np.int64)
        return dim, len(ids), np.array(ids, np.int64)[order].tobytes(), np.dtype(kind).itemsize, data.astype(kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        names = ["dim", "n", "ids", "width", "data"]
        pack = lambda x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names)
        for batch in batches:
            lists = batch.column(1)
            values, where = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                x = values[where[i] : where[i + 1]]
                ids, found = held.setdefault(len(x), ([], []))
                ids.append(vec_id)
                found.append(x)
                if len(ids) == rows:
                    yield pack(flush(ids, found, len(x)))
                    del held[len(x)]
        for dim, (ids, found) in held.items():
            yield pack(flush(ids, found, dim))

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "dim int, n int, ids binary, width int, data binary")


def _matrix(data: bytes, width: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; beyond the range of a long, the nearest long."""
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if top < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, int(_LONG.min), int(_LONG.max)).astype(np.int64)


def best(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, column) of the k highest scores of each row, without columns of the query's own id; ids ascend, and ties go to the first."""
    own = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    mask = np.zeros(scores.shape, bool)
    for i in np.flatnonzero(own[1] > own[0]):
        mask[i, own[0][i] : own[1][i]] = True
    n = scores.shape[1]
    if float(np.abs(scores.astype(float)).max(initial=0)) * n < 2**61:
        key = scores * n + (n - 1 - np.arange(n))
        key[mask] = _LONG.min + 1
        top = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), scores.shape)
    else:
        top = np.stack([np.lexsort((np.arange(n), -row.astype(float), -row.astype(object), m))[:k] for row, m in zip(scores, mask, strict=True)])
    rows = np.repeat(np.arange(len(scores)), top.shape[1])
    columns = top.ravel()
    keep = ~mask[rows, columns]
    return rows[keep], columns[keep], scores[rows[keep], columns[keep]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k rows of vectors with the highest score for each row of queries (both vec_id, embedding): query_id, rank from 1, vec_id, score.

    score: inner product of floor(256 x). Ties go to the smaller vec_id; rows with the query's own id are no candidates.
    Rows with a null id and vectors that are null, empty or not finite take no part; vectors of unlike lengths have no
    score. A query id that occurs more than once asks once, with its least vector; repeated rows of vectors each count.
    """
    asked = queries.filter(F.col("vec_id").isNotNull() & valid("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = cut(blocks(vectors.filter(F.col("vec_id").isNotNull() & valid("embedding"))), "rows")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()
    groups = max(1, min(count, max(-(-size // GROUP_BYTES), rows.sparkSession.sparkContext.defaultParallelism)))  # each gets a copy of the queries
    rows = rows.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    asked = blocks(asked).select("dim", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, ...]] = {}

        def out(keys: list[tuple]) -> Iterator[pa.RecordBatch]:
            for key in keys:
                q, v, s = held.pop(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), key[0])), pa.array(q), pa.array(v), pa.array(s)], ["branch", "query_id", "vec_id", "score"])

        for batch in batches:
            for x in (dict(zip(batch.schema.names, values, strict=True)) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                q_ids, ids = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["ids"], np.int64)
                scores = products(_matrix(x["q_data"], x["q_width"], x["dim"]), _matrix(x["data"], x["width"], x["dim"]))
                r, c, s = best(scores, q_ids, ids, k)
                found = q_ids[r], ids[c], s
                key = (x["g"], x["dim"], x["q_ids"][:8], len(q_ids))
                if key in held:
                    q, v, s = (np.concatenate(z) for z in zip(held[key], found, strict=True))
                    order = np.lexsort((v, -s.astype(float), q)) if np.abs(s.astype(float)).max(initial=0) < 2**53 else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(s[i]), v[i])), int)
                    q, v, s = q[order], v[order], s[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    found = q[place < k], v[place < k], s[place < k]
                held[key] = found
                if len(held) > HELD:
                    yield from out(list(held)[:-1])
        yield from out(list(held))

    pairs = rows.join(asked, ["g", "dim"]).select("g", "dim", "q_ids", "q_width", "q_data", "ids", "width", "data")
    tops = pairs.mapInArrow(tiles, "branch long, query_id long, vec_id long, score long")
    while True:
        final = groups == 1
        groups = -(-groups // FAN)
        tops = tops.withColumn("branch", F.floor(F.col("branch") / FAN))
        window = Window.partitionBy("query_id", *([] if groups == 1 else ["branch"])).orderBy(F.col("score").desc(), "vec_id")
        tops = tops.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
        if final or groups == 1:
            return tops.select("query_id", "rank", "vec_id", "score")
        tops = tops.drop("rank")
