"""Checks of documents, notes and pages; each is a table of what is wrong, and report() the verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..store import cut


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of expected without one of the same keys in found."""
    return expected.join(found.select(*keys).distinct(), keys, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_numbers(rows: DataFrame, number: str, step: int = 1) -> DataFrame:
    """(low, high): the gaps in a series of numbers, each as its first and last missing one. Gaps are found between neighbours of ranges that overlap by one row, so that no task has all rows."""
    spread = rows.select(F.col(number).cast("long").alias("n")).filter("n is not null").distinct()
    edges = spread.withColumn("_b", F.floor(F.col("n") / 100_000))
    inner = edges.withColumn("_p", F.lag("n").over(Window.partitionBy("_b").orderBy("n")))
    ends = edges.groupBy("_b").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    outer = ends.withColumn("_p", F.lag("high").over(Window.orderBy("_b"))).select(F.col("low").alias("n"), "_p")  # one row per 100,000 numbers
    pairs = inner.filter("_p is not null").select("n", "_p").unionByName(outer.filter("_p is not null"))
    return pairs.filter(F.col("n") - F.col("_p") > step).select((F.col("_p") + step).alias("low"), (F.col("n") - step).alias("high"))


def numbered_report(rows: DataFrame, group: str, number: str, text: str, short: int = 40, long: int = 2500) -> DataFrame:
    """(group, paragraphs, low, high, missing, repeated, median, short, long) of rows with a number: the range of numbers, how many are missing in it or come again, the median length, and texts (not empty ones) shorter or longer than usual."""
    n, size = F.col(number).cast("long"), F.length(t.strip(t.plain(text)))
    some = rows.filter(n.isNotNull()).select(group, n.alias("_n"), size.alias("_size"))
    kinds = F.count_distinct("_n")
    return some.groupBy(group).agg(
        F.count("*").alias("paragraphs"), F.min("_n").alias("low"), F.max("_n").alias("high"), (F.max("_n") - F.min("_n") + 1 - kinds).alias("missing"), (F.count("*") - kinds).alias("repeated"),
        F.median("_size").alias("median"), F.count_if((F.col("_size") > 0) & (F.col("_size") < short)).alias("short"), F.count_if(F.col("_size") > long).alias("long"),
    )


def mid_sentence(lines: DataFrame, group: str = "doc_id") -> DataFrame:
    """Lines that begin in lower case after one without an end."""
    before = F.lag("text").over(Window.partitionBy(group).orderBy("idx"))
    return lines.withColumn("_b", before).filter(t.strip("text").rlike(r"^\p{Ll}") & ~t.strip("_b").rlike(t.SENTENCE_END)).drop("_b")


def lengths(lines: DataFrame, group: str = "doc_id", longest: int = 4000) -> DataFrame:
    """(group, lines, longest, runaway, blank): size of a document's lines, how many are too long, and how many hold no letter or digit."""
    n = F.length("text")
    return lines.groupBy(group).agg(F.count("*").alias("lines"), F.max(n).cast("long").alias("longest"), F.count_if(n >= longest).alias("runaway"), F.count_if(~F.col("text").rlike(r"[\p{L}\p{N}]")).alias("blank"))


def sampled_pages(rows: DataFrame, group: str, page: str, samples: int = 8) -> DataFrame:
    """Of each group's pages (from 1) at most so many, evenly spaced; all if there are no more."""
    n = F.count("*").over(Window.partitionBy(group))
    at = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.bround(i * n / samples, 0).cast("long") + 1)
    return rows.withColumns({"_n": n, "_at": at}).filter((F.col("_n") <= samples) | F.array_contains("_at", F.col(page).cast("long"))).drop("_n", "_at")


def report(blocks: DataFrame, pages: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, name, status, detail) of the checks of each document's page (doc_id, html) against its blocks and notes."""
    there = lambda name: F.regexp_extract_all("html", F.lit(f'{name}="(para-[^"]+)"'), F.lit(1))
    complete, loaded = F.col("html").contains("</html>"), F.col("html").rlike(r'(?i)<script[^>]+src="[^"]*notes[^"]*"')
    read = cut(pages.select("doc_id", there("id").alias("ids"), there("data-para").alias("buttons"), (~complete).alias("open"), (~loaded).alias("unloaded")), "pages")  # pages are made and read once
    kinds = ("para", "shown", "button", "noted", "silent")
    rows = lambda found, id_, **of: found.select("doc_id", id_.alias("id"), *[of.get(k, F.lit(0)).alias(k) for k in kinds])
    one = F.lit(1)
    all_ = rows(blocks.filter("kind = 'para'"), F.col("id"), para=one).unionByName(rows(read, F.explode("ids"), shown=one)).unionByName(rows(read, F.explode("buttons"), button=one))
    all_ = all_.unionByName(rows(notes, F.col("para"), noted=one, silent=F.when(t.strip(t.plain("text")) == "", 1).otherwise(0)))
    by_id = all_.groupBy("doc_id", "id").agg(*[F.sum(k).alias(k) for k in kinds])
    none = F.col("shown") == 0
    wrong = {
        "paragraphs on the page": F.when(none, F.col("para")).otherwise(0), "ids unique": F.when(F.col("shown") > 1, 1).otherwise(0), "notes have paragraphs": F.when(none, F.col("noted")).otherwise(0),
        "paragraphs clickable": F.when(F.col("button") == 0, F.col("shown")).otherwise(0) + F.when(none, F.col("button")).otherwise(0), "notes have text": F.col("silent"),
    }
    by_doc = by_id.groupBy("doc_id").agg(*[F.struct(F.sum(n).alias("n"), F.min(F.when(n > 0, F.col("id"))).alias("first")).alias(name) for name, n in wrong.items()])
    whole = {"page complete": "open", "notes file loaded": "unloaded"}
    by_page = read.groupBy("doc_id").agg(*[F.struct(F.count_if(c).alias("n"), F.lit("").alias("first")).alias(name) for name, c in whole.items()])

    def verdict(name: str) -> Column:
        bad = F.coalesce(F.col(f"`{name}`.n"), F.lit(0)) > 0
        detail = F.when(bad, F.format_string("%d, first %s", F.col(f"`{name}`.n"), F.col(f"`{name}`.first"))).otherwise("")
        return F.struct(F.lit(name).alias("name"), F.when(bad, "warn" if name == "notes have text" else "fail").otherwise("ok").alias("status"), detail.alias("detail"))

    out = read.select("doc_id").join(by_doc, "doc_id", "left").join(by_page, "doc_id", "left")
    return out.select("doc_id", F.inline(F.array(*[verdict(name) for name in (*wrong, *whole)])))
