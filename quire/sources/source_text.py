"""The plain source format of an instrument: KEY: value and IDMAP lines, ---, then "## heading" or "{key} marker text" lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.blocks import keyed

META, ALIAS = r"^([A-Z][A-Z_]*):\s*(.*)$", r"(?i)^IDMAP\s+([\w.:-]+)\s*=\s*([\w.-]+)\s*$"
HEADING, KEY = r"^##\s+(.*)$", r"^\{([\w.-]+)\}\s*(.*)$"
MARKER = r"(?i)^(¶|§[0-9]*|[0-9]+\.|\([0-9]+\)|\([a-z]+\)|\([ivxlcdm]+\)|[•·▪‣◦])\s+(.*)$"
META_ORDER = ("TITLE", "DESC", "HEADER", "HOME", "CLOSING")


def read(spark, path: str) -> DataFrame:
    """(doc_id, text) of files; doc_id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    text = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.split(text, "\n")
    dash = F.array_min(F.transform(lines, lambda x, i: F.when(x.contains("---") & (t.strip(x) == "---"), i)))
    split = docs.select("doc_id", F.inline(F.array(F.struct(lines.alias("lines"), dash.alias("dash")))))  # generated, so that no filter of lines looks for the dash again
    return split.select("doc_id", "dash", F.posexplode("lines").alias("line_no", "raw")).select("doc_id", "line_no", "raw", t.strip("raw").alias("line"), "dash")


def parse(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) to meta (doc_id, name, value), aliases (doc_id, old_id, key) and blocks (doc_id, ord, kind, text, label, level, key, id).

    Paragraphs without a key are numbered among all of the document. errors() tells what is wrong with a document.
    """
    lines = _lines(docs)
    front = lines.filter(F.col("line_no") < F.col("dash"))
    aliases = front.filter(F.col("line").rlike(ALIAS)).groupBy("doc_id", F.regexp_extract("line", ALIAS, 1).alias("old_id")).agg(F.max_by(F.regexp_extract("line", ALIAS, 2), "line_no").alias("key"))
    named = front.filter(F.col("line").rlike(META) & ~F.col("line").rlike(ALIAS))
    meta = named.groupBy("doc_id", F.regexp_extract("line", META, 1).alias("name")).agg(F.max_by(t.strip(F.regexp_extract("line", META, 2)), "line_no").alias("value"))
    body = lines.filter((F.col("line") != "") & (F.col("dash").isNull() | (F.col("line_no") > F.col("dash"))))
    is_head = F.col("line").rlike(HEADING)
    rest = F.when(F.col("line").rlike(KEY), t.strip(F.regexp_extract("line", KEY, 2))).otherwise(F.col("line"))
    rows = body.select("doc_id", "line_no", F.when(is_head, "heading").otherwise("para").alias("kind"), F.when(is_head, t.strip(F.regexp_extract("line", HEADING, 1))).otherwise(rest).alias("rest"), F.nullif(F.regexp_extract("line", KEY, 1), F.lit("")).alias("given")).filter("rest <> ''")
    marked = (F.col("kind") == "para") & F.col("rest").rlike(MARKER)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    number = F.sum(F.when(F.col("kind") == "para", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    head_key = t.content_key(F.when(F.col("kind") == "heading", F.concat(F.lit("heading:"), "rest")))
    rows = rows.withColumn("_head", head_key)
    key = F.when(F.col("kind") == "heading", F.col("_head")).otherwise(F.coalesce("given", number.cast("string")))
    label = F.when(F.col("kind") == "heading", "").when(marked, F.regexp_extract("rest", MARKER, 1)).otherwise("¶")
    blocks = rows.select(
        "doc_id", F.row_number().over(order).alias("ord"), "kind", F.when(marked, t.strip(F.regexp_extract("rest", MARKER, 2))).otherwise(F.col("rest")).alias("text"),
        label.alias("label"), F.when(F.col("kind") == "heading", t.heading_level("rest")).otherwise(0).alias("level"), key.alias("key"),
    )
    return meta, aliases, blocks.withColumn("id", F.concat(F.lit("para-"), "key"))


def errors(docs: DataFrame) -> DataFrame:
    """(doc_id, error): front matter without ---, an id given twice, no paragraphs."""
    first = _lines(docs).filter("line <> ''").groupBy("doc_id").agg(F.min_by("line", "line_no").alias("line"), F.max("dash").alias("dash"))
    open_ = first.filter(F.col("dash").isNull() & (F.col("line").rlike(META) | F.col("line").rlike(ALIAS))).select("doc_id", F.lit("front matter without ---").alias("error"))
    _, _, blocks = parse(docs)
    paras = blocks.filter("kind = 'para'")
    twice = paras.groupBy("doc_id", "id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.concat(F.lit("id given twice: "), "id").alias("error"))
    none = docs.select("doc_id").join(paras.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("error", F.lit("no paragraphs"))
    return open_.unionByName(twice).unionByName(none)


def _ordered(line: Column, order: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("x")))), lambda s: s["x"])


def render(blocks: DataFrame, meta: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): the source text of each document's blocks; parse() reads it back."""
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "text")).otherwise(F.concat(F.lit("{"), "key", F.lit("} "), "label", F.lit(" "), "text"))
    out = blocks.groupBy("doc_id").agg(_ordered(line, F.col("ord")).alias("body"))
    empty = F.array().cast("array<string>")
    if meta is not None:
        place = F.array_position(F.array(*[F.lit(m) for m in META_ORDER]), F.col("name"))
        out = out.join(meta.filter(F.col("name").isin(*META_ORDER) & (F.col("value") != "")).groupBy("doc_id").agg(_ordered(F.concat("name", F.lit(": "), "value"), place).alias("meta")), "doc_id", "left")
    if aliases is not None:
        out = out.join(aliases.groupBy("doc_id").agg(_ordered(F.concat(F.lit("IDMAP "), "old_id", F.lit("="), "key"), F.col("old_id")).alias("ids")), "doc_id", "left")
    parts = [F.coalesce(c, empty) for c in ("meta", "ids") if c in out.columns]
    return out.select("doc_id", F.array_join(F.concat(*parts, F.array(F.lit("---"), F.lit("")), F.col("body"), F.array(F.lit(""))), "\n").alias("text"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Each line of a text as a paragraph block, keyed."""
    from ..operators.layout import lines_of

    rows = lines_of(docs).select("doc_id", "idx", "text", F.inline(F.array(F.struct(t.is_structural_heading("text").alias("head"), t.marker(t.strip("text")).alias("m")))))  # generated: evaluated once
    head = F.col("head")
    blocks = rows.select("doc_id", F.col("idx").alias("ord"), F.when(head, "heading").otherwise("para").alias("kind"), F.when(head, t.strip("text")).otherwise(F.col("m.rest")).alias("text"), F.when(head, "").otherwise(F.col("m.label")).alias("label"), F.when(head, t.heading_level("text")).otherwise(0).alias("level"))
    return keyed(blocks.filter("text <> ''"), together=True)
