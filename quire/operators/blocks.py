"""Blocks of a document: headings and paragraphs from lines, with keys made from their text.

The assemblers are folds over a document's lines in order. What a row needs that doesn't depend on the fold (markers, headings,
boundaries) is computed by column expressions before it, and the fold itself runs over short stretches of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as t
from . import layout

QUOTE_LIMIT, RECITAL_LENGTH, RECITAL_BLOCKS = 8000, 120, 8
BLOCKS = "kind string, text string, label string, level int, ord int"


def keyed(blocks: DataFrame, group: str = "doc_id", together: bool = False) -> DataFrame:
    """blocks (group, ord, kind, text) with key, the hash of the text, and -2, -3 ... for its repeats in order; and id.

    together: rows are dealt by group, for what groups by it next; only for groups that one task holds anyway.
    """
    base = t.content_key(F.concat(F.when(F.col("kind") == "heading", "heading:").otherwise(""), t.plain("text")))  # folded once, whatever the kind
    n = F.row_number().over(Window.partitionBy(group, "_base").orderBy("ord"))
    out = blocks.withColumn("_base", base)
    out = (out.repartition(group) if together else out).withColumn("_n", n)
    out = out.withColumn("key", F.when(F.col("_n") > 1, F.concat("_base", F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col("_base")))
    return out.withColumn("id", F.concat(F.lit("para-"), "key")).drop("_base", "_n")


def sections(blocks: DataFrame, group: str = "doc_id") -> DataFrame:
    """blocks with section: the headings above, outermost first, joined by " / "."""
    before = Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    level = lambda k: F.struct(F.max(F.when((F.col("kind") == "heading") & (F.col("level") == k), F.col("ord"))).over(before).alias("at"), F.last(F.when((F.col("kind") == "heading") & (F.col("level") == k), F.col("text")), True).over(before).alias("text"))
    marked = blocks.withColumns({f"_h{k}": level(k) for k in (1, 2, 3)})
    part = lambda k: F.when(F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"_h{j}.at"), F.lit(-1)) for j in range(1, k)]) <= F.coalesce(F.col(f"_h{k}.at"), F.lit(-2)), F.col(f"_h{k}.text"))
    return marked.withColumn("section", F.concat_ws(" / ", *[part(k) for k in (1, 2, 3)])).drop("_h1", "_h2", "_h3")


def split_recitals(blocks: DataFrame, group: str = "doc_id") -> DataFrame:
    """The first long unmarked paragraphs split before the cues of recitals; ord renewed."""
    able = (F.col("kind") == "para") & (F.col("label") == "¶") & (F.length("text") > RECITAL_LENGTH)
    turn = F.sum(F.when(able, 1).otherwise(0)).over(Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    parts = F.when(F.col("_able") & (F.col("_turn") <= RECITAL_BLOCKS), F.split("text", r"(?<=[,;])\s+(?=" + t.RECITAL[1:] + ")")).otherwise(F.array("text"))
    by = Window.partitionBy(group).orderBy("ord")
    out = blocks.withColumns({"_able": able, "_turn": turn}).withColumn("_parts", parts)
    out = out.withColumn("_before", F.coalesce(F.sum(F.size("_parts")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # no second sort
    out = out.select(*[c for c in blocks.columns if c != "text"], "_before", F.posexplode("_parts").alias("_part", "text"))
    return out.withColumn("ord", (F.col("_before") + F.col("_part") + 1).cast("int")).select(*blocks.columns)


def boundaries(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, idx, col, text, x0, y0, x1, y1, size, bold, indent) with what the assembler asks of each: marker (its rest only where there is one), heading, quotes."""
    by, page, whole = Window.partitionBy("doc_id").orderBy("page", "col", "idx"), Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id")
    beside = F.lag("page").over(by).eqNullSafe(F.col("page")) & F.lag("col").over(by).eqNullSafe(F.col("col"))
    out = layout.with_modal(lines, ["doc_id"], F.bround("size", 1), "body", F.greatest(F.lit(1), F.length("text")))
    out = out.withColumn("gap", layout.as_gap(F.when(beside, F.col("y0") - F.lag("y0").over(by)))).withColumns({"left": F.min("x0").over(page), "right": F.max("x1").over(page), "_s": t.stripped("text")})
    s, said, unmarked = F.col("_s"), F.col("_said"), F.struct(F.lit("¶").alias("label"), F.lit(None).cast("string").alias("rest"))
    out = out.withColumns({"_said": t.without_closers(s), "_n": F.length(s)})
    # What only the text says comes before the last window and the rest after it: in one step the code made of them would be too long for the JVM to compile.
    out = out.withColumns({
        "marked": t.has_marker("text"), "bare": F.col("_n").isNotNull() & (F.col("_n") <= 8) & t.is_bare_marker(s), "structural": F.coalesce(F.col("_n") <= 60, F.lit(True)) & t.is_heading_line(t.plain(s)), "quotes": t.quote_balance("text"), "recital": s.rlike(t.RECITAL),
        "stops": t.ends_in(said, ".;!?"), "ends": t.ends_in(said, ".;:!?"), "pauses": t.ends_in(said, ".,;:!?"), "lists": t.ends_in(s, ",;"), "opens": s.rlike(f"^[{t.OPENING}]"),
    }).withColumn("mark", F.when(F.col("marked"), t.marker("text")).otherwise(unmarked))
    out = out.withColumn("spacing", F.mode("gap", True).over(whole)).drop("gap").filter("doc_id is not null and page is not null")
    n, size, base, bold = F.col("_n"), F.col("size"), F.col("body"), F.coalesce("bold", F.lit(False))
    wide = F.col("right") - F.col("left")
    set_apart = (F.abs("indent") <= 2) | ((wide > 0) & (F.abs((F.col("x0") - F.col("left")) - (F.col("right") - F.col("x1"))) < F.greatest(F.lit(6.0), wide * 0.12)))
    like_label = ~s.rlike(r"[,;:!?]\s*$") & ~s.contains(",")
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.greatest(F.lit(1), F.length(letters))
    short = (n <= 80) & ~s.rlike(t.SENTENCE_END)
    large = size >= base * 1.18
    level = (
        F.when((n == 0) | (n > 200), 0)
        .when(s.rlike(t.HEADING) & (size >= base * 0.95), t.heading_level(s))
        .when(short & s.rlike(r"^[IVXLCDM]{1,7}\.\s+.+$") & (bold | (size > base * 1.05)), 3)
        .when(short & s.rlike(r"^[A-Z]\.\s+.{0,70}$") & bold & (size > base * 1.02), 3)
        .when((n <= 90) & (large | (bold & (size >= base * 0.98))) & like_label & set_apart, F.when(large, 2).otherwise(3))
        .when((n <= 90) & (F.length(letters) >= 4) & like_label & (capitals >= 0.85) & set_apart, 2)
        .otherwise(0)
    )
    return out.withColumn("level", level.cast("int")).drop("left", "right", "_s", "_said", "_n")


def begins_paragraph(by: WindowSpec) -> Column:
    """Whether a line (of boundaries()) begins a new paragraph after the one before it. The tests stand in order of precedence."""
    before = lambda c: F.lag(c).over(by)
    true = lambda c: F.coalesce(c, F.lit(False))
    stopped, step = true(before("stops")), F.col("indent") - before("indent")
    sized = F.abs(F.col("size") - before("size")) > F.greatest(F.lit(0.6), 0.08 * F.col("body"))
    bolder = true(F.col("bold")) & ~true(before("bold")) & true(F.col("size") >= F.col("body"))
    return (
        F.when(before("page").isNull() | ~F.col("col").eqNullSafe(before("col")), True)
        .when(F.col("page") != before("page"), true(before("ends")))
        .when(true(sized) | bolder, True)
        .when(F.col("opens") & ~stopped, False)
        .when(true((F.col("spacing") > 0) & (F.col("y0") - before("y0") > 1.4 * F.col("spacing"))) & stopped, True)
        .when(~true(before("bare") | before("marked")) & true(step > 2), F.when(step <= F.greatest(F.lit(24.0), 3 * F.col("body")), true(before("pauses"))).otherwise(stopped))
        .otherwise(true(before("lists")) & F.col("recital"))
    )


_BLOCK = "struct<kind:string,label:string,level:int,lines:array<string>>"


def folded_lines(rows: Column) -> Column:
    """Blocks of a stretch of lines, in order: what is new depends on what the block before it is, and on the quotation that it may have left open."""

    def begun(r: Column) -> Column:
        head = r["level"] > 0
        return F.struct(F.when(head, "heading").otherwise("para").alias("kind"), F.when(head, "").otherwise(r["label"]).alias("label"), F.when(head, r["level"]).otherwise(0).cast("int").alias("level"), F.array(first_text(r)).alias("lines"))

    def first_text(r: Column) -> Column:
        return F.when(r["level"] > 0, t.strip(r["text"])).otherwise(F.coalesce(r["first"], r["text"]))

    def step(s: Column, r: Column) -> Column:
        last = F.try_element_at(s["blocks"], F.lit(-1))
        quoted = (s["quotes"] > 0) & (s["size"] < QUOTE_LIMIT)
        new = r["hard"] | last.isNull() | (last["kind"] == "heading") | (~quoted & r["soft"])
        text = F.when(new, first_text(r)).otherwise(r["text"])
        head, made = new & (r["level"] > 0), begun(r)
        longer = F.struct(last["kind"].alias("kind"), last["label"].alias("label"), last["level"].alias("level"), F.concat(last["lines"], F.array(r["text"])).alias("lines"))
        blocks = F.when(new, F.concat(s["blocks"], F.array(made))).otherwise(F.concat(F.slice(s["blocks"], F.lit(1), F.greatest(F.lit(0), F.size(s["blocks"]) - 1)), F.array(longer)))
        return F.struct(
            blocks.cast(f"array<{_BLOCK}>").alias("blocks"), F.when(head, 0).when(new, r["quotes"]).otherwise(s["quotes"] + r["quotes"]).cast("int").alias("quotes"),
            (F.when(new, 0).otherwise(s["size"]) + F.length(text)).cast("int").alias("size"),
        )

    zero = F.struct(F.array().cast(f"array<{_BLOCK}>").alias("blocks"), F.lit(0).alias("quotes"), F.lit(0).alias("size"))
    alone = F.array(begun(rows[0])).cast(f"array<{_BLOCK}>")  # most stretches are of one line
    return F.when(F.size(rows) == 1, alone).otherwise(F.aggregate(rows, zero, step, lambda s: s["blocks"]))


def assembled(lines: DataFrame) -> DataFrame:
    """lines as for boundaries() to blocks (doc_id, ord, kind, text, label, level, key, id, section).

    A line's boundary depends on the line before it, which windows show, and on the state of the block it would join: whether
    that is a heading, and whether a quotation is open in its last QUOTE_LIMIT characters. Lines that begin a block whatever
    the state are known beforehand: those after a bare marker, and those with a boundary before which no quotation was opened
    for so many characters. They cut a document into short stretches, which are folded each by itself.
    """
    by = Window.partitionBy("doc_id").orderBy("page", "col", "idx")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    asked = boundaries(lines)
    rows = asked.withColumns({"hard": F.lag("page").over(by).isNull() | F.coalesce(F.lag("bare").over(by), F.lit(False)), "soft": F.col("marked") | F.col("structural") | begins_paragraph(by), "pending": F.when(F.lag("bare").over(by), F.lag("mark").over(by)["label"])})
    pending = F.coalesce("pending", F.lit("")) != ""
    rows = rows.filter(~F.col("bare")).select(
        "doc_id", "page", "col", "idx", (F.col("hard") | pending).alias("hard"), "soft", F.col("quotes").cast("int").alias("quotes"), "text", F.when(pending, 0).otherwise(F.col("level")).alias("level"),
        F.when(pending, F.col("pending")).otherwise(F.col("mark.label")).alias("label"), F.when(F.col("marked"), F.col("mark.rest")).alias("first"),
    )
    least = F.least(F.length(F.coalesce("first", "text")), F.length(t.stripped("text")))  # what the line adds to its block's length at least
    rows = rows.withColumn("_sum", F.sum(least).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", least)
    opened = F.max(F.when(F.col("quotes") > 0, F.col("_sum"))).over(before)
    free = opened.isNull() | (opened <= F.col("_sum") - F.col("_n") - QUOTE_LIMIT)
    rows = rows.withColumn("_cut", F.col("hard") | (F.col("soft") & free)).withColumn("_stretch", F.sum(F.col("_cut").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.struct("page", "col", "idx", "hard", "soft", "quotes", "text", "level", "label", "first")
    found = rows.groupBy("doc_id", "_stretch").agg(F.array_sort(F.collect_list(held)).alias("rows")).select("doc_id", "_stretch", F.posexplode(folded_lines(F.col("rows"))).alias("_k", "b"))
    raw = found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("_stretch", "_k")).alias("ord"), "b.*")
    whole = raw.join(layout.compounds(lines), "doc_id", "left")
    text = t.joined_lines(F.col("lines"), F.coalesce("compounds", F.array().cast("array<string>")))
    said = F.exists("lines", lambda x: t.plain(x).rlike(r"[\p{L}\p{N}]"))  # joining takes hyphens and blanks only
    blocks = whole.filter((F.col("kind") == "heading") | said).select("doc_id", "ord", "kind", text.alias("text"), "label", "level")
    return sections(keyed(split_recitals(blocks), together=True))


def assembled_word(paragraphs: DataFrame) -> DataFrame:
    """paragraphs of a word processor's file (doc_id, ord, text, level from its style, 0 for none) to blocks; those that continue the one before join it."""
    s = t.strip("text")
    level = F.when(F.col("level") > 0, F.col("level")).when(t.is_structural_heading("text"), 2).otherwise(0)
    rows = paragraphs.filter(s != "").withColumns({"level": level, "mark": t.marker(s), "_marked": t.has_marker(s)})
    by = Window.partitionBy("doc_id").orderBy("ord")
    rows = rows.withColumn("body", F.when(F.col("_marked") & (F.col("level") == 0), F.col("mark.rest")).otherwise(s))
    joins = (F.col("level") == 0) & ~F.col("_marked") & (F.lag("level").over(by) == 0) & t.continues(F.lag("body").over(by), F.col("body"))
    rows = rows.withColumn("_block", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "ord")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"])
    blocks = rows.groupBy("doc_id", F.col("_block").cast("int").alias("ord")).agg(lists.alias("lines"), first("level").cast("int").alias("level"), first(F.when(F.col("_marked"), F.col("mark.label")).otherwise("¶")).alias("label"))
    kind = F.when(F.col("level") > 0, "heading").otherwise("para")
    out = blocks.select("doc_id", "ord", kind.alias("kind"), t.joined_lines(F.col("lines")).alias("text"), F.when(F.col("level") > 0, "").otherwise(F.col("label")).alias("label"), "level")
    return sections(keyed(out))


def positional_aliases(blocks: DataFrame) -> DataFrame:
    """(doc_id, old_id, key): para-1, para-2 ... for the paragraphs in order."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return blocks.filter("kind = 'para'").select("doc_id", F.concat(F.lit("para-"), n.cast("string")).alias("old_id"), "key")
