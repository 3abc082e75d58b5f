"""What the operators share: checked broadcasts and vectorised word hashes, beside the shared folder of the library."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import cut, release, shared_dir, spread

__all__ = ["cut", "join_small", "release", "shared_dir", "table", "unit_hash"]

#: A side of a join is broadcast only if its measured size is at most so many bytes.
BROADCAST_BYTES = 16 << 20
#: White space of the word rule `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))  # where workers on this machine find the package
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def width(kind: T.DataType, value: Column) -> Column:
    """About the bytes that a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * (16 * len(kind.elementType) if isinstance(kind.elementType, T.StructType) else 24 if isinstance(kind.elementType, T.StringType) else 8) + 24
    return F.lit(16 * len(kind) if isinstance(kind, T.StructType) else 8)


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df, which are counted and measured, take at most `limit` bytes."""
    row = F.lit(16).cast("long")
    for field in df.schema:
        row = row + width(field.dataType, F.col(field.name))
    return (df.agg(F.sum(row)).first()[0] or 0) <= limit


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """left join right, which is small as a rule: broadcast if it was measured and is, else a shuffled join, whose hot keys AQE splits."""
    return left.join(F.broadcast(right) if is_small(right, limit) else right, on, how)


def unit_hash(*cols: Column | str) -> Column:
    """A hash of the columns, from 0 to below 1."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")) / F.lit(float(1 << 53))


# Words as 64-bit hashes, whole batches at once.

_MIX, _R = np.uint64(0xFF51AFD7ED558CCD), 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[[0x20, 9, 10, 11, 12, 13]] = 0
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def chunks(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of about `most` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a pyarrow string column (null: empty) and where each row begins; the last offset is the end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the rows data[offsets[i]:offsets[i + 1]], and where each row's words begin in that list."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    local = (offsets - base).astype(np.int64)
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = _IS_SPACE[part]
    first = np.ones(len(part), bool)
    first[1:] = blank[:-1]
    first[local[:-1][local[:-1] < len(part)]] = True
    starts = np.flatnonzero(first & ~blank)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _pow(len(part))
    sums = np.add.reduceat((_LOWER if lower else _BYTES)[part] * up[: len(part)], starts)
    return mix64(sums * down[starts]), np.searchsorted(starts, local)
