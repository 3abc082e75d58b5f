"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import spread


#: Lines with clause markers, headings, contents entries and page numbers, made of the plain ones by their number; the same in Spark and DuckDB.
DECORATED = """CASE idx % 9 WHEN 1 THEN concat('(', CAST(idx AS STRING), ') ', text) WHEN 2 THEN concat(CAST(idx AS STRING), '. ', text)
 WHEN 3 THEN concat('Article ', CAST(idx AS STRING), ' ', substr(text, 1, 30)) WHEN 4 THEN concat('(b) ', text) WHEN 5 THEN concat('§ ', CAST(idx AS STRING), ' ', text)
 WHEN 6 THEN concat('• ', text) WHEN 7 THEN concat(substr(text, 1, 20), ' ..... ', CAST(idx AS STRING)) WHEN 8 THEN CAST(idx AS STRING) ELSE text END"""
#: Every third line broken within a word.
BROKEN = "CASE idx % 3 WHEN 0 THEN concat(text, 'in-') ELSE lower(text) END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))  # where workers on this machine find the package
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lines(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    """(doc_id, source, idx, text): the lines of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("idx", "text")).filter("trim(text) <> ''")
    return rows if text == "text" else rows.withColumn("text", F.expr(text))


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines set on pages of 40, in one column, with sizes, boldness and margins derived from their number and length."""
    rows = lines(spark, sf_dir, DECORATED)
    at = F.col("idx") % 40
    x0 = F.lit(100.0) + F.when(F.col("idx") % 5 == 0, 12.0).otherwise(0.0)
    size = F.when(F.col("idx") % 9 == 3, 12.0).otherwise(10.0)
    return rows.select("doc_id", (F.floor(F.col("idx") / 40) + 1).cast("int").alias("page"), F.col("idx").cast("int"), F.lit(0).alias("col"), "text", x0.alias("x0"), (60.0 + at * 18 + (at % 7)).alias("y0"), F.least(F.lit(500.0), x0 + F.length("text") * 5.0).alias("x1"), (60.0 + at * 18 + (at % 7) + size).alias("y1"), size.alias("size"), (F.col("idx") % 9 == 3).alias("bold"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as notes: conv_id is the paragraph, turn the place, role the author; sixteen documents."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") % 16).alias("doc_id"), F.concat(F.lit("para-"), F.col("conv_id").cast("string")).alias("para"), F.col("turn").alias("idx"), F.col("role").alias("author"), F.lit("").alias("title"), "text", F.lit("").alias("source"), F.col("conv_id").alias("para_ord"))


def notes_by_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes with a document for each conversation, so that their number grows with the input and a document's text doesn't."""
    return notes(spark, sf_dir).withColumn("doc_id", F.col("para_ord"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as the paragraphs that exist."""
    rows = table(spark, sf_dir, "labels")
    return rows.select((F.col("doc_id") % 16).alias("doc_id"), F.concat(F.lit("para-"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("ord"), F.concat(F.lit("Paragraph "), F.col("doc_id").cast("string")).alias("text")).dropDuplicates(["id"])


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as quotes within one document, the corpus."""
    return table(spark, sf_dir, "benchmark").select(F.lit(0).alias("doc_id"), F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the paragraphs of that document."""
    return table(spark, sf_dir, "documents").select(F.lit(0).alias("doc_id"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), "text")


def place(idx: str) -> Column:
    """The place of a document's line among those of all documents."""
    return F.col("doc_id") * 2**32 + F.col(idx)


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as the paragraphs of one; part is the document each is from."""
    return lines(spark, sf_dir).select(F.lit(0).alias("doc_id"), F.col("doc_id").alias("part"), place("idx").alias("ord"), F.concat_ws("-", "doc_id", "idx").alias("id"), "text")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new paragraphs of each source: documents by their number are in the old version, in the new one, or in both."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("para-"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), "text")
    return docs.filter(F.col("ord") % 3 != 0), docs.filter(F.col("ord") % 3 != 1)


__all__ = ["BROKEN", "DECORATED", "all_lines", "corpus", "labelled", "lines", "notes", "notes_by_paragraph", "place", "positioned", "quotes", "table", "versions"]
