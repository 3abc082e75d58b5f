"""Numbered paragraphs of rulings: where the body begins behind a table of contents, and the formula that stands before it.

Rows are (doc_id, ord, row_type, label, text), lines (doc_id, idx, text). Both searches look at a bounded stretch: so many
paragraphs forward from each that is numbered 1, and so many lines back from the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Paragraphs that are compared with 1, 2, 3 ...; lines before the first one that are searched; characters of a line that goes on from a formula.
FORWARD, BACK, GOES_ON = 25, 140, 260
# How the lines of a formula begin, and which of them go on in the next line.
FORMULAS = ("The International Court of Justice,", "Composed as above,", "After deliberation,", "Having regard to", "Makes the following", "Finds as follows", "Gives the following", "Delivers the following")
OPEN_FORMULAS = ("having regard to", "after deliberation", "the international court of justice")
_FIRST = r"^(?U:\s*)0{0,3}1\.(?U:\s)+.*\S"
_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


def is_page_range(text: str | Column) -> Column:
    """Whether a line ends in two numbers of pages."""
    return t.strip(t.plain(text)).rlike(r"\b[0-9]{1,4}\s*-\s*[0-9]{1,4}$")


def is_caption(text: str | Column) -> Column:
    """Whether a line is a heading: one numbered in Roman numerals or by a letter, or a short one in title case without a full stop."""
    s = t.strip(t.plain(text))
    titled = ~s.rlike(rf"(?<!{_CASED})\p{{Ll}}") & ~s.rlike(rf"(?<={_CASED})[\p{{Lu}}\p{{Lt}}]")
    return (s != "") & (s.rlike(r"^(?:[IVXLCDM]{1,8}|[A-Z])\.(?U:\s)+\S") | ((F.length(s) <= 80) & titled & ~s.endswith(".")))


def body_begin(rows: DataFrame) -> DataFrame:
    """(doc_id, ord): the row at which the body begins: of the paragraphs labelled 1., the one from which most of the next FORWARD are numbered on, then those with the longer texts, then fewer that end in pages, then the first; without any, the first row."""
    by = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(0, FORWARD - 1)
    number = F.regexp_replace(t.plain("label"), "[^0-9]", "").try_cast("long")
    paras = rows.filter("row_type = 'para'").withColumn("x", F.struct(number.alias("n"), F.length(t.plain("text")).alias("size"), is_page_range("text").cast("int").alias("pages")))
    seen = paras.withColumn("xs", F.collect_list("x").over(by)).filter(t.strip(t.plain("label")).startswith("1."))
    total = lambda name: F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: s + x[name])
    run = F.size(F.filter(F.transform("xs", lambda x, i: x["n"] == i + 1), lambda ok: ok))
    found = seen.groupBy("doc_id").agg(F.max_by("ord", F.struct(run, total("size") / F.size("xs"), -total("pages"), -F.col("ord"))).alias("at"))
    first = rows.groupBy("doc_id").agg(F.min("ord").alias("first"))
    return first.join(found, "doc_id", "left").select("doc_id", F.coalesce("at", "first").alias("ord"))


def lead_in(lines: DataFrame) -> DataFrame:
    """(doc_id, lead): the lines of the formula before the first paragraph numbered 1, repeats that follow one another once; documents without any are left out."""
    one = lines.filter(t.plain("text").rlike(_FIRST)).groupBy("doc_id").agg(F.min("idx").alias("_one"))
    near = lines.join(one, "doc_id").filter((F.col("idx") < F.col("_one")) & (F.col("idx") >= F.col("_one") - BACK)).select("doc_id", "idx", t.squeezed(t.plain("text")).alias("s")).filter("s <> ''")
    begins = lambda s, some: F.exists(F.array(*[F.lit(x.lower()) for x in some]), lambda x: F.startswith(F.lower(s), x))
    rows = near.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "s", begins(F.col("s"), FORMULAS).alias("formula"), is_page_range("s").alias("pages")))).alias("xs"))

    def step(block: Column, x: Column) -> Column:
        last = F.try_element_at(block, F.lit(-1))
        goes_on = last.isNotNull() & begins(F.coalesce(last, F.lit("")), OPEN_FORMULAS) & (F.length(x["s"]) <= GOES_ON) & ~x["pages"]
        return F.when(x["formula"] | goes_on, F.concat(block, F.array(x["s"]))).otherwise(block)

    none = F.array().cast("array<string>")
    block = F.aggregate("xs", none, step)
    once = F.aggregate("block", none, lambda out, s: F.when(F.try_element_at(out, F.lit(-1)).eqNullSafe(s), out).otherwise(F.concat(out, F.array(s))))
    return rows.select("doc_id", block.alias("block")).select("doc_id", once.alias("lead")).filter(F.size("lead") > 0)


def body_with_lead(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows from the body's beginning on, behind a row of type lead with the formula, if there is one, whose ord is one less."""
    at = body_begin(rows).withColumnRenamed("ord", "_at")
    body = rows.join(at, "doc_id").filter(F.col("ord") >= F.col("_at")).drop("_at")
    lead = at.join(lead_in(lines), "doc_id").select("doc_id", (F.col("_at") - 1).alias("ord"), F.lit("lead").alias("row_type"), F.lit("").alias("label"), F.array_join("lead", " ").alias("text"))
    return body.select("doc_id", "ord", "row_type", "label", "text").unionByName(lead)
