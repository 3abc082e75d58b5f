"""New files of a folder as they come: documents keyed into paragraphs, notes searched for what is new.

Each micro-batch goes through the same functions as a batch job. Documents are whole files, so that a batch never holds
a part of one, and keys within it are final; what a batch writes carries its number, so that a batch that runs again after
a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import keyed
from ..operators.layout import lines_of


def documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files: int = 100) -> DataFrame:
    """A stream of the rows of Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def keyed_paragraphs(docs: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes (doc_id, ord, kind, text, key, id) of the documents of a stream to out/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        rows = lines_of(batch).select("doc_id", F.col("idx").alias("ord"), F.lit("para").alias("kind"), "text")
        keyed(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def note_counts(notes: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """notes (at timestamp, author) of a stream to counts by author and window; rows later than `late` are left out."""
    return notes.withWatermark("at", late).groupBy(F.window("at", window), "author").agg(F.count("*").alias("notes"))
