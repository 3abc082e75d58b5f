"""Layout of positioned lines: (doc_id, page, idx, text, x0, y0, x1, y1, size, bold), one row per visual line, idx in reading order of a page.

All windows are within a document or page; documents are dealt out by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t

HEADER_BAND, FOOTER_BAND, NARROW_LINE, ISOLATED = 0.22, 0.18, 0.7, 1.6
GUTTER_POINTS, GUTTER_SHARE, COLUMN_SHARE = 10.0, 0.015, 0.1
BODY_RUN, BODY_LENGTH, BODY_SHARE, BODY_REACH = 5, 120, 0.45, 400
TAIL_LINES, TAIL_SHARE, FRONT_LINES = 60, 0.2, 120


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, idx, text): the lines of each text that aren't blank; idx from 0 counts blank ones too."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("idx", "text")).filter(t.strip("text") != "")


def without_repeats(lines: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """Of lines that look alike at the same place (folded text and keys), the first."""
    place = F.row_number().over(Window.partitionBy(*keys, t.folded("text")).orderBy(order))
    return lines.withColumn("_n", place).filter("_n = 1").drop("_n")


def modal(rows: DataFrame, keys: list[str], value: str, weight: Column | None = None, first_seen: str | None = None) -> DataFrame:
    """The most frequent value for the keys (by weight); ties go to the smaller value, or to the one seen first by a column."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_w"), F.min(first_seen or value).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_w", -F.col("_first"))).alias(value))


def with_modal(rows: DataFrame, keys: list[str], value: Column, name: str, weight: Column) -> DataFrame:
    """rows with the value that modal() finds for their keys by weight, by windows: rows that are dealt by the keys stay where they are."""
    weighed = rows.withColumn("_v", value).withColumn("_w", F.sum(weight).over(Window.partitionBy(*keys, "_v")))
    best = F.max(F.when(F.col("_v").isNotNull(), F.struct(F.col("_w").alias("w"), (-F.col("_v")).alias("v")))).over(Window.partitionBy(*keys))
    return weighed.withColumn(name, -best["v"]).drop("_v", "_w")


def gaps(lines: DataFrame, keys: list[str], top: str = "y0", order: str = "idx") -> DataFrame:
    """lines with gap: the rounded distance from the line before, where it is above 0 and below 200."""
    return lines.withColumn("gap", as_gap(F.col(top) - F.lag(top).over(Window.partitionBy(*keys).orderBy(order))))


def as_gap(step: Column) -> Column:
    step = F.bround(step, 0)
    return F.when((step > 0) & (step < 200), step)


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, size): the font size of most characters, to a tenth."""
    sized = lines.withColumn("size", F.bround("size", 1))
    return modal(sized, ["doc_id"], "size", F.greatest(F.lit(1), F.length("text")))


def furniture(lines: DataFrame, height: Column, group: str = "doc_id", page: str = "page", share: float = 0.5) -> DataFrame:
    """(group, band, key, pages): folded lines, as they are or with numbers as #, that the top or bottom bands of half the pages repeat."""
    band = F.when(F.col("y0") <= HEADER_BAND * height, "header").when(F.col("y1") >= (1 - FOOTER_BAND) * height, "footer")
    several = lines.groupBy(group).agg((F.min(page) < F.max(page)).alias("_several")).filter("_several").select(group)  # nothing repeats on a single page
    keyed = lines.withColumn("band", band).filter("band is not null").join(several, group, "left_semi").withColumn("keys", t.furniture_keys("text"))
    return repeated(keyed.filter("band is not null").select(group, page, "band", "keys"), lines, group, page, share)


def repeated(keyed: DataFrame, lines: DataFrame, group: str, page: str, share: float = 0.5) -> DataFrame:
    """keyed (group, page, band, keys): the keys that occur on half of the group's pages and on two at least."""
    pages = lines.groupBy(group).agg(F.count_distinct(page).alias("all_pages"))
    keys = keyed.select(group, page, "band", F.explode(F.array_distinct(F.array("keys.exact", "keys.counted"))).alias("key")).filter("key is not null and key <> ''")
    found = keys.distinct().groupBy(group, "band", "key").agg(F.count("*").alias("pages"))
    return found.join(pages, group).filter(F.col("pages") >= F.greatest(F.lit(2.0), F.bround(F.col("all_pages") * share, 0))).select(group, "band", "key", "pages")


def drop_furniture(lines: DataFrame, found: DataFrame, height: Column, width: Column) -> DataFrame:
    """lines without repeated ones, without page numbers and browser lines in the bands, and without a page's isolated first or last line.

    A first or last line of a page of three lines and more is isolated if it stands in its band, is narrow, and lies further
    from its neighbour, from box to box, than ISOLATED times the document's usual step from line to line, of which equally
    frequent ones the first seen counts. A document's first line stays, unless it goes for another reason.
    """
    known = found.groupBy("doc_id").agg(F.collect_set("key").alias("_known"))  # few: each is on half of a document's pages
    in_head, in_foot = F.col("y0") <= HEADER_BAND * height, F.col("y1") >= (1 - FOOTER_BAND) * height
    keys = t.furniture_keys(F.when(F.col("_known").isNotNull(), F.col("text")))  # only where something is repeated
    gone = F.coalesce(F.array_contains("_known", keys["exact"]), F.lit(False)) | F.coalesce(F.array_contains("_known", keys["counted"]), F.lit(False)) | ((in_head | in_foot) & (t.is_page_number("text") | t.is_browser_line("text")))
    seen = gaps(lines, ["doc_id", "page"]).withColumn("_seen", F.col("page") * F.lit(1 << 32).cast("long") + F.col("idx"))
    spacing = modal(seen, ["doc_id"], "gap", first_seen="_seen").withColumnRenamed("gap", "_spacing")
    page = Window.partitionBy("doc_id", "page")
    by = page.orderBy("idx")
    # Lines are dealt by document once, for both joins and all windows; keys come last, as a UDF forgets how rows are dealt.
    rows = lines.join(known, "doc_id", "left").join(spacing, "doc_id", "left").withColumns({
        "_first": F.row_number().over(by) == 1, "_last": F.lead("idx").over(by).isNull(), "_n": F.count("*").over(page),
        "_below": F.lead("y0").over(by) - F.col("y1"), "_above": F.col("y0") - F.lag("y1").over(by), "_start": F.min("page").over(Window.partitionBy("doc_id")) == F.col("page"),
    }).withColumn("_gone", gone)
    narrow = ((F.col("x1") - F.col("x0")) <= NARROW_LINE * width) & (F.col("_n") >= 3) & F.col("_spacing").isNotNull()
    far = ISOLATED * F.col("_spacing")
    alone = narrow & ((F.col("_first") & ~F.col("_start") & in_head & (F.col("_below") > far)) | (F.col("_last") & in_foot & (F.col("_above") > far)))
    return rows.filter(~(F.col("_gone") | F.coalesce(alone, F.lit(False)))).select(*lines.columns)


def drop_before_body(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """lines from each document's start (doc_id, start: a line's number from 1) on; all of documents that have none."""
    return _numbered(lines, starts).filter(F.col("start").isNull() | (F.col("_at") >= F.col("start"))).select(*lines.columns)


def drop_tail_matter(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """lines before each document's start (doc_id, start: a line's number from 1) of the matter at its end; all of documents that have none."""
    return _numbered(lines, starts).filter(F.col("start").isNull() | (F.col("_at") < F.col("start"))).select(*lines.columns)


def _numbered(lines: DataFrame, starts: DataFrame) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "idx"))
    return lines.withColumn("_at", at).join(starts.select("doc_id", "start"), "doc_id", "left")


def _with_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """lines beside the boxes (doc_id, page, box_id, box) of their page, with _line, their own box."""
    return lines.withColumn("_line", g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).join(boxes, ["doc_id", "page"])


def text_under(lines: DataFrame, boxes: DataFrame, least: float = 0.25) -> DataFrame:
    """(doc_id, page, box_id, text): in order, the lines of which a box covers a quarter at least; boxes without any have no row."""
    rows = _with_boxes(lines, boxes).filter(g.overlap_share(F.col("_line"), F.col("box")) >= least)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "page", "box_id").agg(t.squeezed(F.array_join(parts, " ")).alias("text"))


def nearest_line(lines: DataFrame, boxes: DataFrame, least: float = 0.2) -> DataFrame:
    """(doc_id, page, box_id, idx): the first line of which a box covers more than a fifth, else the nearest: lines beside it, then the smaller distance up or down, then sideways; of equal ones the first."""
    up, side = (g.gap(F.col("box"), F.col("_line"), axis) for axis in "yx")
    zero = F.lit(0.0)
    rank = F.when(g.overlap_share(F.col("_line"), F.col("box")) > least, F.struct(F.lit(-1).alias("a"), zero.alias("b"), zero.alias("c"), "idx"))
    rank = rank.otherwise(F.struct(F.when(up < 0, 0).otherwise(1).alias("a"), F.greatest(zero, up).alias("b"), F.greatest(zero, side).alias("c"), "idx"))
    return _with_boxes(lines, boxes).groupBy("doc_id", "page", "box_id").agg(F.min_by("idx", rank).alias("idx"))


def runs(rows: DataFrame, keys: list[str], order: str, hit: Column, least: int = 1) -> DataFrame:
    """(keys, start, length): unbroken runs of rows for which hit holds, of so many rows at least."""
    by = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumns({"_nth": F.row_number().over(by), "_hit": hit}).filter("_hit")
    islands = numbered.withColumn("_island", F.col("_nth") - F.row_number().over(by))
    return islands.groupBy(*keys, "_island").agg(F.min("_nth").alias("start"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("_island")


def front_matter(lines: DataFrame) -> DataFrame:
    """(doc_id, kind, start, length): contents, labels or an index among the first lines; the longest run, of equal ones the first; contents before labels before index."""
    order = Window.partitionBy("doc_id").orderBy("page", "idx")
    first = lines.withColumns({"_at": F.row_number().over(order), "_all": F.count("*").over(Window.partitionBy("doc_id"))}).filter((F.col("_at") <= FRONT_LINES) & (F.col("_all") >= 8))
    label = F.col("text").rlike(r"^(?:[A-Z]{1,3}|[IVXLCDM]{1,6}|[0-9]{1,3})\.\s+\S") & (F.length("text") <= 90) & ~F.col("text").rlike(r"[.,;:!?]\s*$")
    index = F.regexp_count("text", F.lit(r"\s[–—]\s")) >= 2
    kinds = [(0, "contents", t.is_contents_entry("text"), 4), (1, "labels", label, 4), (2, "index", index, 6)]
    found = None
    for rank, kind, hit, least in kinds:
        part = runs(first, ["doc_id"], "_at", hit, least).withColumns({"kind": F.lit(kind), "_rank": F.lit(rank)})
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id").agg(F.max_by(F.struct("kind", "start", "length"), F.struct(-F.col("_rank"), F.col("length"), -F.col("start"))).alias("x")).select("doc_id", "x.*")


def tail_matter(lines: DataFrame) -> DataFrame:
    """(doc_id, start): where an index at the end begins, if it is in the last lines and leaves at most a fifth of the document."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "idx"))
    last = lines.withColumns({"_at": at, "_all": F.count("*").over(Window.partitionBy("doc_id"))}).filter((F.col("_all") >= 12) & (F.col("_at") > F.col("_all") - TAIL_LINES))
    titles = last.filter(F.lower(t.strip("text")) == "contents").groupBy("doc_id", "_all").agg(F.min("_at").alias("start")).withColumn("_rank", F.lit(0))
    listed = runs(last, ["doc_id", "_all"], "_at", t.is_contents_entry("text"), 3)
    firsts = last.groupBy("doc_id").agg(F.min("_at").alias("_low"))
    listed = listed.join(firsts, "doc_id").groupBy("doc_id", "_all").agg(F.min(F.col("start") + F.col("_low") - 1).alias("start")).withColumn("_rank", F.lit(1))
    both = titles.unionByName(listed).filter(F.col("_all") - F.col("start") + 1 <= F.greatest(F.lit(4), F.floor(F.col("_all") * TAIL_SHARE)))
    return both.groupBy("doc_id").agg(F.min_by("start", "_rank").alias("start"))


def body_start(lines: DataFrame) -> DataFrame:
    """(doc_id, start): line number of the "1." in a document's first part from which 1 to 5 follow within reach, with the longest mean line, 120 characters at least; of equal ones the first."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "idx"))
    numbered = lines.withColumns({"_at": at, "_all": F.count("*").over(Window.partitionBy("doc_id")), "_no": F.regexp_extract(t.strip("text"), r"^([0-9]{1,3})[.)]\s", 1).try_cast("int")}).filter((F.col("_all") >= 10) & F.col("_no").isNotNull())
    mark = F.struct(F.col("_at").alias("at"), F.col("_no").alias("no"), F.length("text").alias("n"))
    marks = numbered.groupBy("doc_id", "_all").agg(F.array_sort(F.collect_list(mark)).alias("marks"))  # numbered lines of one document
    state = lambda at: F.struct(F.lit(1).alias("next"), F.lit(0).alias("chars"), at.alias("at"))
    walk = lambda s, m: F.when((m["at"] >= s["at"]) & (m["at"] <= s["at"] + BODY_REACH) & (m["no"] == s["next"]) & (s["next"] <= BODY_RUN), F.struct((s["next"] + 1).alias("next"), (s["chars"] + m["n"]).alias("chars"), s["at"].alias("at"))).otherwise(s)
    starts = F.filter("marks", lambda m: (m["no"] == 1) & (m["at"] <= F.floor(F.col("_all") * BODY_SHARE)))
    tried = F.transform(starts, lambda m: F.aggregate("marks", state(m["at"]), walk))
    good = F.filter(tried, lambda s: (s["next"] > BODY_RUN) & (s["chars"] / BODY_RUN >= BODY_LENGTH))
    return marks.select("doc_id", F.explode(good).alias("s")).groupBy("doc_id").agg(F.max_by("s.at", F.struct("s.chars", -F.col("s.at"))).alias("start"))


def indents(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines with indent: x0 less the column's margin, which is the x0 at a twentieth of all in order."""
    by = Window.partitionBy(*keys)
    ranked = lines.withColumns({"_r": F.row_number().over(by.orderBy(F.bround("x0", 0), "x0")), "_n": F.count("*").over(by)})
    margin = F.max(F.when(F.col("_r") == F.floor(F.col("_n") * 0.05) + 1, F.bround("x0", 0))).over(by)
    return ranked.withColumn("indent", F.bround("x0", 0) - margin).drop("_r", "_n")


def clusters(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """rows with cluster, from 0: a new one begins where the value is more than the tolerance above the one before."""
    by = Window.partitionBy(*keys).orderBy(value)
    step = F.when(F.col(value) - F.lag(value).over(by) > tolerance, 1).otherwise(0)
    return rows.withColumn("_new", step).withColumn("cluster", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def reading_order(lines: DataFrame, keys: list[str], tolerance: float = 3.0) -> DataFrame:
    """lines with ord, from 1: by bands of y0, then x0."""
    banded = clusters(lines, keys, "y0", tolerance)
    return banded.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("cluster", "x0", "y0"))).drop("cluster")


def column_bands(x0: np.ndarray, x1: np.ndarray, width: float, most: int = 3) -> list[tuple[float, float]]:
    """Text columns of one page from its lines' extents: the gutters are runs of thinly covered 2-point bins with lines on both sides and few across."""
    whole = [(0.0, width)]
    narrow = (x1 - x0) < 0.75 * width
    if len(x0) < 4 or narrow.sum() < 4:
        return whole
    a, b = x0[narrow], x1[narrow]
    bins = int(np.ceil(width / 2)) + 1
    cover = np.zeros(bins + 1)
    np.add.at(cover, np.clip((a / 2).astype(int), 0, bins), 1)
    np.add.at(cover, np.clip((b / 2).astype(int) + 1, 0, bins), -1)
    cover = np.cumsum(cover)[:bins]
    low = cover <= max(1, int(0.25 * cover.max()))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], low, [0]])))
    least, sides, across = max(1, int(max(GUTTER_POINTS, GUTTER_SHARE * width) / 2)), max(2, int(COLUMN_SHARE * narrow.sum())), max(1, int(COLUMN_SHARE * len(x0)))
    gutters = []
    for s, e in zip(edge[::2], edge[1::2], strict=True):
        left, right = 2.0 * s, 2.0 * e
        if s and e - s >= least and (b <= right).sum() >= sides and (a >= left).sum() >= sides and ((x0 < left) & (x1 > right)).sum() <= across:
            gutters.append((left, right))
    gutters = sorted(sorted(gutters, key=lambda g: g[0] - g[1])[: most - 1])
    cuts = [0.0, *((left + right) / 2 for left, right in gutters), width]
    bands = [(p, q) for p, q in zip(cuts, cuts[1:], strict=False) if ((a >= p) & (a < q)).sum() >= sides]
    return bands if len(bands) > 1 else whole


def columns(lines: DataFrame, width: float) -> DataFrame:
    """lines with col, the column from 0: the band that holds x0, or else the nearest. A page is in one task, which has many pages, and holds one of them beyond a batch."""
    rows = lines.drop("col")
    names, schema = rows.columns, rows.withColumn("col", F.lit(0)).schema
    rows = rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page")

    def placed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x0, x1 = (np.concatenate([b.column(names.index(c)).to_numpy(zero_copy_only=False) for b in held]).astype(float) for c in ("x0", "x1"))
        keys = pd.concat([b.select(["doc_id", "page"]).to_pandas() for b in held], ignore_index=True)
        same = ((keys == keys.shift()) | (keys.isna() & keys.shift().isna())).all(axis=1).to_numpy()
        same[:1] = False
        begins = np.append(np.flatnonzero(~same), len(x0))
        col = np.zeros(len(x0), np.int32)
        for s, e in zip(begins[:-1], begins[1:], strict=True):
            bands = column_bands(x0[s:e], x1[s:e], width)
            if len(bands) > 1:
                centre = (x0[s:e] + x1[s:e]) / 2
                col[s:e] = np.stack([np.where((x0[s:e] >= p) & (x0[s:e] < q), -1.0, np.minimum(abs(centre - p), abs(centre - q))) for p, q in bands]).argmin(axis=0)
        whole = pa.Table.from_batches(held).combine_chunks()
        return pa.RecordBatch.from_arrays([*(whole.column(n).combine_chunks() if whole.column(n).num_chunks != 1 else whole.column(n).chunk(0) for n in names), pa.array(col)], [*names, "col"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(names.index(c)) for c in ("doc_id", "page")]
            last = [c[-1].as_py() for c in key]
            start = batch.num_rows - 1  # where the batch's last page begins
            while start and [c[start - 1].as_py() for c in key] == last:
                start -= 1
            if start == 0 and held and [held[-1].column(names.index(c))[-1].as_py() for c in ("doc_id", "page")] == last:
                held.append(batch)
                continue
            if held or start:
                yield placed([*held, *([batch.slice(0, start)] if start else [])])
            held = [batch.slice(start)]
        if held:
            yield placed(held)

    return rows.mapInArrow(run, schema)


def compounds(lines: DataFrame) -> DataFrame:
    """(doc_id, compounds): the hyphenated words that stand within a line of the document, lower-case."""
    able = F.contains("text", F.lit("-"))
    hyphened = F.when(able, F.col("text"))  # tested here too, as Spark puts the search for words into a filter of its own
    found = lines.filter(able).select("doc_id", F.explode(F.regexp_extract_all(F.lower(hyphened), F.lit(t.COMPOUND), F.lit(0))).alias("word"))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("word")).alias("compounds"))
