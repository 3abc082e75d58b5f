"""Texts of one side against all of the other within a document: which hold one another, and which are alike.

The texts of both sides are packed into blocks, a row each, and every block of one side meets every block of the other in a
task that reads both from the shared folder. Nothing is dealt by words or pairs, so disk grows with the texts only; time
grows with the product of the sides, by a few steps for each pair of texts and a look at the pairs that share enough words.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import pickle
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as t
from ..store import cut

#: Characters of the texts of a block, about: for small tables fewer, so that there are BLOCKS of the asked side for each core.
LEAST_CHARS, BLOCK_CHARS, BLOCKS = 2**20, 2**22, 4
#: Counts that a task holds at once.
COUNTS = 500_000
#: Share of a text's words, the rarest first, that are looked up; the others are counted for the pairs that can still reach what is asked.
LOOKED_UP = 0.7
#: Rows that are handed to Python at once, and what sets them.
ROWS, _HANDED = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _handing(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within hands so many rows to Python at once."""
    was = spark.conf.get(_HANDED)
    spark.conf.set(_HANDED, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_HANDED, was)


def _give_back() -> None:
    """Return freed memory: workers that wait for their next task would keep it beside those that run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64("doc_id", w), 32))


def _order(numbers: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 to 2**32, by halves."""
    order = np.argsort(numbers.astype(np.uint16), kind="stable")
    high = (numbers >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def _placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, id, at, text): those rows (doc_id, ord, id, text) that places (doc_id, ord, id, at) has. Both are dealt once, by ranges, and meet where they stand."""
    both = rows.select("doc_id", "ord", "id", "text", F.lit(None).cast("double").alias("at")).unionByName(places.select("doc_id", "ord", "id", F.lit(None).cast("string").alias("text"), "at"))
    here = Window.partitionBy("doc_id", "ord", "id")
    return both.repartitionByRange("doc_id", "ord").withColumn("at", F.max("at").over(here)).filter("at is not null and text is not null").select("doc_id", "id", "at", "text")


def packed(rows: DataFrame, name: str, size: int = BLOCK_CHARS) -> DataFrame:
    """(block, low, high): rows (doc_id, id, at, text) as blocks of documents from low to high; with each text, folded, its distinct words as hashes, those inside it before those that only stand at its ends.

    Words of one hash count as the same word until texts are compared.
    """
    rows = rows.select("doc_id", "id", "at", t.folded("text").alias("norm"))
    inner = F.array_distinct(F.slice(F.split("norm", " "), 2, F.greatest(F.size(F.split("norm", " ")) - 2, F.lit(0))))
    some = rows.filter(F.col("doc_id").isNotNull() & (F.col("norm") != "")).select("doc_id", "id", "at", "norm", inner.alias("_in"))
    some = some.select("doc_id", "id", "at", "norm", F.size("_in").alias("m"), _hashed(F.concat("_in", F.array_except(t.words("norm"), "_in"))).alias("w"))

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        words = rows.column("w").combine_chunks()
        vocabulary, of = np.unique(words.flatten().to_numpy().astype(np.uint32), return_inverse=True)
        sizes = words.value_lengths().to_numpy()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.drop_columns(["w"]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.drop_columns(["w"]))
        body = pickle.dumps((sink.getvalue().to_pybytes(), vocabulary, pa.compress(of.astype(np.int32).tobytes(), "zstd", asbytes=True), sizes), protocol=5)
        out = pa.RecordBatch.from_arrays([pa.array([pickle.dumps((uuid.uuid4().hex, body), protocol=5)], pa.binary()), *(rows.column("doc_id").combine_chunks().take(pa.array([k])) for k in (0, rows.num_rows - 1))], names=["block", "low", "high"])
        del rows, words, vocabulary, of, body
        _give_back()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for batch in batches:
            ends = np.cumsum([len(x) for x in batch.column("norm").to_pylist()])
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + size - chars)))
                held.append(batch.slice(start, stop - start))
                chars += int(ends[min(stop, batch.num_rows) - 1] - before)
                start = stop
                if chars >= size or start < batch.num_rows:
                    yield block(held)
                    held, chars = [], 0
        if held:
            yield block(held)

    schema = some.select(F.lit(b"").alias("block"), F.col("doc_id").alias("low"), F.col("doc_id").alias("high")).schema
    with _handing(rows.sparkSession, ROWS):
        return cut(some.sortWithinPartitions("doc_id", F.length("norm")).mapInArrow(run, schema), name, maxRecordsPerFile=1)


class _Block:
    """Texts and their words, read again from a row of packed()."""

    def __init__(self, body: bytes) -> None:
        table, self.vocabulary, of, self.size = pickle.loads(body)
        rows = pa.ipc.open_stream(table).read_all()
        self.n = rows.num_rows
        self.doc, self.id, self.norm = rows.column("doc_id").combine_chunks(), rows.column("id").combine_chunks(), rows.column("norm").to_pylist()
        self.at, self.inner = rows.column("at").to_numpy(), rows.column("m").to_numpy()
        self.size = self.size.astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.of = np.frombuffer(pa.decompress(of, 4 * int(self.size.sum()), "zstd", asbytes=True), np.int32)
        self.length = np.array([len(x) for x in self.norm], np.int64)
        self.letters = np.array([sim.letters(x) for x in self.norm], np.int32)
        #: Rows by word: those of word k are by_word[first[k] : first[k + 1]].
        self.by_word = np.repeat(np.arange(self.n, dtype=np.int32), self.size)[_order(self.of)]
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(self.of, minlength=len(self.vocabulary)))])
        docs = self.doc.to_pylist()
        starts = [k for k in range(self.n) if not k or docs[k] != docs[k - 1]]
        #: From and to which row each document's texts stand.
        self.span = {docs[i]: (i, j) for i, j in zip(starts, [*starts[1:], self.n], strict=True)}
        self._joined: dict[object, tuple[str, list[int]]] = {}

    def rows(self, word: int) -> np.ndarray:
        return self.by_word[self.first[word] : self.first[word + 1]]

    def holding(self, doc: object, text: str) -> Iterator[int]:
        """Rows of a document whose text holds text."""
        begin, end = self.span[doc]
        if doc not in self._joined:
            starts = np.cumsum(self.length[begin:end] + 1) - self.length[begin:end] - 1
            self._joined[doc] = "\n".join(self.norm[begin:end]), starts.tolist()
        whole, starts = self._joined[doc]
        at = whole.find(text)
        while at >= 0:
            k = bisect_right(starts, at)
            yield begin + k - 1
            at = whole.find(text, starts[k]) if k < len(starts) else -1


def _there(x: _Block, y: _Block) -> tuple[np.ndarray, np.ndarray]:
    """For the words of x's texts: which of y's vocabulary they are, and how many of y's texts have them."""
    if not len(y.vocabulary):
        return np.zeros(len(x.of), np.int64), np.zeros(len(x.of), np.int64)
    at = np.minimum(np.searchsorted(y.vocabulary, x.vocabulary), len(y.vocabulary) - 1)
    many = np.where(y.vocabulary[at] == x.vocabulary, y.first[at + 1] - y.first[at], 0)
    return at[x.of], many[x.of]


def _inside(x: _Block, y: _Block, at: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of x and y where x's text is within y's. Whole words inside x's text are in y's, so the rarest leads there; a text of one or two words is looked for in the document's texts."""
    some = np.flatnonzero(x.inner > 0)
    if len(some):
        cuts = np.stack([x.begin[some], x.begin[some] + x.inner[some]], 1).ravel()
        least = np.minimum.reduceat(np.append(many, 0), cuts)[::2]
        for k in some[least > 0].tolist():
            b = x.begin[k]
            word = at[b + int(np.argmin(many[b : b + x.inner[k]]))]
            text = x.norm[k]
            yield from ((k, r) for r in y.rows(word).tolist() if text in y.norm[r])
    docs = x.doc.to_pylist() if len(some) < x.n else []
    for k in np.flatnonzero(x.inner == 0).tolist():
        if docs[k] in y.span:
            yield from ((k, r) for r in y.holding(docs[k], x.norm[k]))


def _alike(x: _Block, y: _Block, at: np.ndarray, many: np.ndarray, asked: np.ndarray, share: float, score: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row of x, rows of y) for the rows asked: texts of y that have that share of the distinct words of x's text, and for whose score lengths, letters and the run's middle leave the value open."""
    ratio = (score - sim.RUN) / sim.RATIO
    row = np.repeat(np.arange(x.n), x.size)
    order = _order(many)
    order = order[_order(row[order])]  # a text's words, the rarest first
    number = np.arange(len(row)) - np.repeat(x.begin, x.size)
    wanted = np.ceil(share * x.size - 1e-9).astype(np.int64)
    looked = np.maximum(np.ceil(LOOKED_UP * x.size).astype(np.int64), x.size - wanted + 1)
    need = np.maximum(1, wanted - (x.size - looked))
    at, many = at[order], many[order]
    use = (number < np.repeat(looked, x.size)) & (many > 0) & asked[row]
    words, counts, rows = at[use], many[use], row[use]
    hits = np.bincount(rows, counts, x.n).astype(np.int64)
    begins = np.searchsorted(rows, np.arange(x.n + 1))
    ends, most, start = np.cumsum(hits), max(1, COUNTS // max(1, y.n)), 0
    flags = np.zeros(len(y.vocabulary), bool)
    while start < x.n:
        before = ends[start - 1] if start else 0
        stop = min(x.n, start + most, max(start + 1, int(np.searchsorted(ends, before + COUNTS, "right"))))
        part = slice(begins[start], begins[stop])
        n = counts[part]
        if n.sum():
            found = y.by_word[np.arange(n.sum()) + np.repeat(y.first[words[part]] - np.cumsum(n) + n, n)]
            table = np.bincount(np.repeat(rows[part] - start, n) * y.n + found, minlength=(stop - start) * y.n).reshape(stop - start, y.n)
            left, right = np.nonzero(table >= need[start:stop, None])
            a, b = x.length[left + start], y.length[right]
            fits = 2.0 * np.minimum(a, b) >= ratio * (a + b) - 1e-9
            left, right = left[fits], right[fits]
            borders = np.searchsorted(left, np.arange(stop - start + 1))
            for k in np.unique(left).tolist():
                near, i = right[borders[k] : borders[k + 1]], start + k
                own = slice(x.begin[i], x.begin[i] + x.size[i])
                mine = at[own][many[own] > 0]
                flags[mine] = True
                size = y.size[near]
                theirs = flags[y.of[np.arange(size.sum()) + np.repeat(y.begin[near] - np.cumsum(size) + size, size)]]
                flags[mine] = False
                near = near[np.add.reduceat(theirs, np.cumsum(size) - size, dtype=np.int64) >= share * x.size[i] - 1e-9]
                upto = 2.0 * np.minimum(x.letters[i], y.letters[near]).sum(1) / (x.length[i] + y.length[near])
                open_ = upto >= score - 1e-9
                for z in np.flatnonzero(~open_ & (sim.RATIO * upto + sim.RUN >= score - 1e-9)).tolist():
                    small, large = sorted((x.norm[i], y.norm[near[z]]), key=len)
                    open_[z] = sim.middle(small, score) in large
                if open_.any():
                    yield i, near[open_]
        start = stop


def _nearest(distance: np.ndarray, rows: np.ndarray, fits) -> list[int]:  # noqa: ANN001
    """Of the rows that fit, those at the least distance; none farther is tried."""
    found: list[int] = []
    best = math.inf
    for k in np.argsort(distance, kind="stable").tolist():
        if distance[k] > best:
            break
        if fits(int(rows[k])):
            found.append(int(rows[k]))
            best = distance[k]
    return found


def _met(x: _Block, y: _Block, share: float, score: float | None) -> Iterator[tuple[int, int, int]]:
    """(row of x, row of y, 0 within one another or 1 alike): for each text of x the nearest of y that is within it or that it is within, else the nearest alike."""
    if not x.span.keys() & y.span.keys():
        return
    at, many = _there(x, y)
    held: dict[int, list[int]] = {}
    if x.length.min() <= y.length.max():
        for k, r in _inside(x, y, at, many):
            held.setdefault(k, []).append(r)
    if y.length.min() <= x.length.max():
        for r, k in _inside(y, x, *_there(y, x)):
            held.setdefault(k, []).append(r)
    for k, rows in held.items():
        some = np.array(rows)
        yield from ((k, r, 0) for r in _nearest(np.abs(x.at[k] - y.at[some]), some, lambda _: True))
    if score is None:
        return
    ratio, asked = (score - sim.RUN) / sim.RATIO, np.zeros(x.n, bool)
    for doc in x.span.keys() & y.span.keys():
        (i, j), (p, q) = x.span[doc], y.span[doc]
        a, least, most = x.length[i:j], y.length[p:q].min(), y.length[p:q].max()
        near = np.clip(a, least, most)  # the length in y that is nearest to a's, or between two
        asked[i:j] = 2.0 * np.minimum(a, near) >= ratio * (a + near) - 1e-9
    asked[list(held)] = False
    if not asked.any():
        return
    known: dict[tuple[str, str], bool] = {}
    for k, rows in _alike(x, y, at, many, asked, share, score):
        a, own = x.norm[k], set(x.norm[k].split(" "))

        def fits(r: int, a: str = a, own: set[str] = own) -> bool:
            pair = a, y.norm[r]
            if pair not in known:
                known[pair] = len(own & set(pair[1].split(" "))) / len(own) >= share and sim.reaches(*pair, score)
            return known[pair]

        yield from ((k, r, 1) for r in _nearest(np.abs(x.at[k] - y.at[rows]), rows, fits))


def met(a: DataFrame, a_at: DataFrame, b: DataFrame, b_at: DataFrame, share: float, score: float | None) -> DataFrame:
    """(doc_id, a_id, b_id, kind) for texts a and b (doc_id, ord, id, text) of a document that have places (doc_id, ord, id, at).

    In each pair of blocks the nearest to a's place of those that hold or are held by it (kind 0), or where there are none of
    those that have that share of its words and the score (kind 1, not without a score).
    """
    spark = a.sparkSession
    chars = a.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    size = min(BLOCK_CHARS, max(LEAST_CHARS, chars // (2 * BLOCKS * spark.sparkContext.defaultParallelism)))
    a, b = _placed(a, a_at), _placed(b, b_at)
    kinds = a.select("doc_id", F.col("id").alias("a_id")).crossJoin(b.select(F.col("id").alias("b_id"))).withColumn("kind", F.lit(0)).schema
    x, y = (packed(rows, name, size).toDF(side, f"{side}_low", f"{side}_high") for rows, name, side in ((a, "asked", "a"), (b, "there", "b")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, kept = to_arrow_schema(kinds), {}
        for batch in batches:
            for pair in zip(batch.column(0), batch.column(1), strict=True):
                sides = []
                for side, value in enumerate(pair):
                    name, body = pickle.loads(value.as_buffer())
                    if kept.get(side, ("",))[0] != name:
                        kept.pop(side, None)
                        kept[side] = name, _Block(body)
                    sides.append(kept[side][1])
                one, other = sides
                found = list(_met(one, other, share, score))
                if found:
                    rows, rows2, kind = (pa.array(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([one.doc.take(rows).cast(schema.field(0).type), one.id.take(rows).cast(schema.field(1).type), other.id.take(rows2).cast(schema.field(2).type), kind.cast(pa.int32())], schema=schema)
        kept.clear()
        sides = one = other = None
        _give_back()

    met_ = (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    pairs = x.hint("shuffle_replicate_nl").join(y, met_).select("a", "b")  # partitions meet without being dealt or sent
    with _handing(spark, 1):
        return cut(pairs.mapInArrow(run, kinds), "met")
