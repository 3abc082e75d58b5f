"""What files held when they were read, and what has changed since; text files by their contents, whatever their times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(content: str | Column) -> Column:
    """SHA-256 of a file's contents; empty where there is none."""
    return F.coalesce(F.sha2(F.col(content) if isinstance(content, str) else content, 256), F.lit(""))


def snapshot(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, digest) of files (path, content)."""
    return files.select("path", fingerprint(content).alias("digest"))


def changes(then: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): deleted, appeared or changed, of two snapshots; files that are as they were have no row."""
    both = then.withColumnRenamed("digest", "_then").join(now.withColumnRenamed("digest", "_now"), "path", "full")
    change = F.when(F.col("_now").isNull(), "deleted").when(F.col("_then").isNull(), "appeared").when(F.col("_then") != F.col("_now"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def saved(store: DataFrame, mine: DataFrame, loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store (path, content) with the files of mine written, and the refused ones (path, change): those that have changed since they were loaded (path, digest)."""
    refused = changes(loaded, snapshot(store)).join(mine.select("path"), "path", "left_semi")
    written = mine.join(refused, "path", "left_anti")
    return store.join(written, "path", "left_anti").unionByName(written), refused
