"""Passages of 50 words that earlier documents have: super-k-mers by minimiser, exact comparison of windows in buckets.

A window's minimiser is the least hash among its grams of GRAM words. Consecutive windows with one minimiser are a run (a
super-k-mer). Runs are first counted by their minimiser and a 128-bit fingerprint of their words, which takes some forty bytes
for each run: a minimiser that only one document has needs nothing more, and where all runs of a minimiser are the same words,
the least document is known at once. What is asked of texts grows with them, so texts are always dealt by document for it. Runs of the other minimisers travel as packed strings, one for each different run, to the
bucket of their minimiser, where their windows are sorted. A bucket with more than BUCKET different runs isn't sorted in one
task: its windows go out by their own fingerprints, are pre-aggregated where they lie, and come back the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import _IS_SPACE, _pow, chunks, cut, join_small, mix64, text_bytes, word_hashes

#: Words of a window and of a gram; windows of a run at most (they fill a mask of 64 bits); different runs that one task sorts.
WINDOW, GRAM, RUN, BUCKET = 50, 8, 64, 4096
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
_OTHER = np.uint64(0x9E3779B97F4A7C15)


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes, for a single long text piece by piece, cut at white space."""
    if len(offsets) > 2 or offsets[-1] - offsets[0] <= 2 * PIECE:
        return word_hashes(data, offsets)
    cuts, end = [int(offsets[0])], int(offsets[-1])
    while end - cuts[-1] > PIECE:
        at = cuts[-1] + PIECE
        while at < end and not _IS_SPACE[data[at : at + 4096]].any():
            at += 4096
        at += int(np.argmax(_IS_SPACE[data[at : at + 4096]])) if at < end else 0
        cuts.append(min(at, end))
    cuts += [end] if cuts[-1] < end else []
    found = np.concatenate([word_hashes(data, np.array(x, np.int64))[0] for x in zip(cuts[:-1], cuts[1:], strict=True)])
    return found, np.array([0, len(found)])


def _runs(words: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows of word hashes (row i: words[where[i]:where[i + 1]]): row, first window, windows, minimiser and two fingerprints of each run."""
    n = len(words)
    if n < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    up, down = _pow(n + 1)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:n], dtype=np.uint64)]) for x in (words, mix64(words ^ _OTHER))]
    least = mix64((sums[0][GRAM:] - sums[0][:-GRAM]) * down[: n - GRAM + 1])
    grams, wide = WINDOW - GRAM + 1, 1
    while 2 * wide <= grams:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    least = np.minimum(least[: n - WINDOW + 1], least[grams - wide :])
    row = np.searchsorted(where, np.arange(n - WINDOW + 1), "right") - 1
    at = np.flatnonzero(np.arange(WINDOW, n + 1) <= where[row + 1])
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])
    first |= (np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))) % RUN == 0
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(at)))
    s = at[begin]
    prints = [mix64((x[s + size + WINDOW - 1] - x[s]) * down[s]) for x in sums]
    return row[s], s - where[row[s]], size, least[s].view(np.int64), prints[0].view(np.int64), prints[1].view(np.int64)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        data, offsets = text_bytes(batch.column(2))
        for a, b in chunks(offsets, PIECE):
            row, start, n, *hashes = _runs(*_hashes(data, offsets[a : b + 1]))
            for i in range(0, len(row), 1 << 16):
                part = [x[i : i + (1 << 16)] for x in (ids[a + row], rows[a + row], start.astype(np.int32), n.astype(np.int32), *hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["doc_id", "row", "start", "n", "key", "a", "b"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, list of runs asked) to a packed string for each run."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("low", pa.int64()), ("hot", pa.bool_()), ("packed", pa.binary())])
    for batch in batches:
        for text, low, asked in zip(*(batch.column(k) for k in range(3)), strict=True):
            words = text.as_py().encode().split()
            runs = asked.as_py()
            for i in range(0, len(runs), 4096):
                out = [(r["key"], r["a"], r["b"], low.as_py(), r["hot"], b" ".join(words[r["start"] : r["start"] + r["n"] + WINDOW - 1])) for r in runs[i : i + 4096]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _windows(packed: bytes) -> list[bytes]:
    words = packed.split(b" ")
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    return [packed[ends[i] : ends[i + WINDOW] - 1] for i in range(len(words) - WINDOW + 1)]


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed runs, ordered by key and fingerprint, to the least document of each window of each run."""
    rows = (dict(zip(batch.schema.names, values, strict=True)) for batch in batches for values in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("least", pa.list_(pa.int64()))])
    out: list[tuple] = []
    for key, bucket in groupby(rows, lambda r: r["key"]):
        runs = [next(same) for _, same in groupby(bucket, lambda r: (r["a"], r["b"]))]  # a repeated row brings the same run again
        least = [[0] * len(_windows(r["packed"])) for r in runs]
        windows = sorted((w, r["low"], k, i) for k, r in enumerate(runs) for i, w in enumerate(_windows(r["packed"])))
        for _, same in groupby(windows, lambda x: x[0]):
            low = None
            for _, doc, k, i in same:
                low = doc if low is None else low
                least[k][i] = low
        out += [(key, r["a"], r["b"], x) for r, x in zip(runs, least, strict=True)]
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed runs to their windows' 128-bit fingerprints."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024).to_pylist()
            found = [(r["key"], r["a"], r["b"], r["low"], k, hashlib.blake2b(w, digest_size=16).digest()) for r in part for k, w in enumerate(_windows(r["packed"]))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], ["key", "a", "b", "low", "i", "w"])


def repeated(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs (doc_id, text) to (doc_id, row, spots): runs with windows that documents of smaller ids have, as (start, mask).

    row: xxhash64 of the text, which tells rows of one doc_id apart. Bit i of mask: the window that begins with word start + i.
    """
    read = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    runs = cut(read.mapInArrow(_found, "doc_id long, row long, start int, n int, key long, a long, b long"), "runs")
    ends = [f(c).alias(f"{n}_{c}") for c in ("doc_id", "a", "b") for n, f in (("min", F.min), ("max", F.max))]
    keys = runs.groupBy("key").agg(*ends).filter("min_doc_id < max_doc_id")
    keys = keys.select("key", F.col("min_doc_id").alias("low"), (F.expr("min_a = max_a and min_b = max_b")).alias("alike"))
    shared = cut(runs.join(keys, "key"), "shared")
    ones = shared.filter("alike and low < doc_id").select("doc_id", "row", "start", F.expr("shiftrightunsigned(-1L, 64 - n)").alias("mask"))
    mixed = shared.filter("not alike")
    texts = cut(mixed.groupBy("key", "a", "b").agg(F.min(F.struct("doc_id", "row", "start", "n")).alias("at")).select("key", "a", "b", "at.*"), "texts")
    hot = cut(texts.groupBy("key").count().filter(F.col("count") > bucket).select("key", F.lit(True).alias("hot")), "hot")
    asked = join_small(texts, hot, "key").groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "a", "b", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked"))
    asked = cut(asked, "asked")
    packed = read.join(asked.hint("merge"), ["doc_id", "row"]).select("text", F.col("doc_id").alias("low"), "asked")
    packed = cut(packed.mapInArrow(_packed, "key long, a long, b long, low long, hot boolean, packed binary"), "packed")
    least = packed.filter("not hot").repartition("key").sortWithinPartitions("key", "a", "b").mapInArrow(_sorted, "key long, a long, b long, least array<long>")
    if not hot.isEmpty():
        windows = cut(packed.filter("hot").mapInArrow(_exploded, "key long, a long, b long, low long, i int, w binary"), "windows")
        lows = windows.groupBy("key", "w").agg(F.min("low").alias("least"))
        back = windows.dropDuplicates(["key", "a", "b", "i"]).join(lows, ["key", "w"]).groupBy("key", "a", "b").agg(F.sort_array(F.collect_list(F.struct("i", "least"))).alias("x"))
        least = least.unionByName(back.select("key", "a", "b", F.col("x.least").alias("least")))
    mask = F.expr("aggregate(sequence(0, n - 1), 0L, (m, i) -> m | shiftleft(cast(least[i] < doc_id as bigint), i))")
    rest = mixed.join(cut(least, "least"), ["key", "a", "b"]).select("doc_id", "row", "start", mask.alias("mask")).filter("mask <> 0")
    return ones.unionByName(rest).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "mask")).alias("spots"))


def _kept(words: list[bytes], spots: list[dict]) -> list[bytes]:
    steps = np.zeros(len(words) + 1, np.int64)
    for spot in spots:
        at = spot["start"] + np.flatnonzero(np.unpackbits(np.array([spot["mask"]], "<i8").view(np.uint8), bitorder="little"))
        np.add.at(steps, at, 1)
        np.add.at(steps, at + WINDOW, -1)
    return [w for w, c in zip(words, np.cumsum(steps).tolist(), strict=False) if not c]


def deduplicated(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs with columns doc_id and text to a row for each row: doc_id, n_words, n_removed, kept (the words left, joined by one space), kept_sha256.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of 50 words that covers it also begins in a document with
    a smaller doc_id; windows are judged on the texts as they came. A null or empty text has no words and keeps an empty text.
    Rows with a null doc_id lose nothing and take nothing from others. Rows that repeat a doc_id are judged each for itself and
    take nothing from one another; extra columns are left out. bucket: different runs of a minimiser that one task sorts.
    """
    spots = cut(repeated(docs, bucket), "spots")
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    joined = read.join(spots.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(i, 256).to_pylist():
                    words = r["text"].encode().split()
                    left = _kept(words, r["spots"]) if r["spots"] else words
                    kept = b" ".join(left)
                    out.append((r["doc_id"], len(words), len(words) - len(left), kept.decode(), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
