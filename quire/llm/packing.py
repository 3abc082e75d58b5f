"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Tokens are counted where the texts lie; what is dealt out afterwards is a row of a few numbers per piece. Pieces are dealt
evenly to shards of a fixed number of items, and each shard is packed by itself, longest items first: an item goes where
the sum over gaps of (open bins with that gap) squared becomes smallest. A shard's loss is a few bins, whatever the input.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import cut

LENGTH, SHARD_ITEMS = 2048, 16_384
#: The ranks hold the vocabulary of byte_bpe_50k.json; tests compare the ids of both.
RANKS = "byte_bpe_50k.tiktoken"


@cache
def encoder(ranks: str):
    """Text to a list of ids; ranks: a file name among the public tokenizers, or a path."""
    import public_tokenizers
    import tiktoken

    with open(ranks if "/" in ranks else public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_ordinary


def pieces_of(text: str | None, encode, length: int = LENGTH, end: int = 0) -> list[tuple[int, int, int]]:
    """(start, length, crc32 of the ids) of each piece of a document: its ids and the end id, cut only if longer than length; then the first piece has the rest."""
    ids = array("I", encode(text or ""))
    ids.append(end)
    data = memoryview(ids).cast("B")
    first = len(ids) if len(ids) <= length else len(ids) % length or length
    cuts = [0, *range(first, len(ids) + 1, length)]
    return [(a, b - a, zlib.crc32(data[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def tokenised(docs: DataFrame, length: int = LENGTH, ranks: str = RANKS) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32) per piece of each document (doc_id, text; null text: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1)):
                for k, (start, n, crc) in enumerate(pieces_of(text.as_py(), encode, length)):
                    for column, value in zip(out, (i, k, start, n, crc), strict=True):
                        column.append(value)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given.

    With n(g) open bins of gap g, an item of size s put into gap g changes the sum of squares by 2 (n(g - s) - n(g)) + 2,
    into a gap that it fills by 1 - 2 n(s). Of equal changes the smallest gap wins. Items come longest first, so a new bin
    is begun only if the item fits no open one; the rule's own choice of new bins would leave half a percent more of them.
    """
    n = np.zeros(length + 1)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        change = np.where(n[s:] > 0, n[: length + 1 - s] - n[s:] + 1, np.inf)
        if n[s]:
            change[0] = 0.5 - n[s]
        j = int(change.argmin())
        if s == length or change[j] == np.inf:
            bins[i], gap, made = made, length - s, made + 1
        else:
            g = s + j
            bins[i], offsets[i], gap = open_bins[g].pop(), length - g, j
            n[g] -= 1
        if gap:
            n[gap] += 1
            open_bins[gap].append(int(bins[i]))
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """pieces (length long, from 1 to the given length; any more columns are kept) with sequence_id and offset, gapless from 0 in each sequence.

    pieces must be stable: a table, or what cut() returns. Repeated rows are packed as often as they occur.
    """
    shards = max(1, -(-pieces.count() // shard_items))
    schema = pieces.drop("sequence_id", "offset").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    names = schema.names

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.iloc[np.argsort(-items["length"].to_numpy(), kind="stable")]
        bins, offsets = sum_of_squares(items["length"].to_numpy(), length)
        return items.assign(sequence_id=bins * shards + key[0], offset=offsets)[names]

    dealt = pieces.drop("sequence_id", "offset").withColumn("_shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(run, schema)


def packed(docs: DataFrame, length: int = LENGTH, ranks: str = RANKS) -> DataFrame:
    """The pieces of docs (doc_id, text), tokenised and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(tokenised(docs, length, ranks), "pieces"), length)
