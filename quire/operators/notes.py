"""Notes on paragraphs: (doc_id, para, idx, author, title, text, source), idx from 0 in each paragraph. Search, edits as new tables, and planned merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as t
from ..store import cut

FIELDS = ("author", "title", "text", "source")
SIMILAR, SAME_RUN, SAME_CHARS = 0.55, 0.9, 60
#: SAME_RUN in tenths.
TENTHS = 9
#: Characters of the pieces by which texts that say the same are looked up; at most the middle of a text of SAME_CHARS less half of its places.
PIECE = 24


def cleaned(notes: DataFrame) -> DataFrame:
    """Fields trimmed, empty ones null, notes without text gone."""
    return notes.withColumns({f: F.nullif(t.strip(f), F.lit("")) for f in FIELDS if f in notes.columns}).filter("text is not null")


def searched(notes: DataFrame, paras: DataFrame | None = None, text: str = "", author: str = "", para: str = "", orphans: bool = False) -> DataFrame:
    """The notes of an author and paragraph that hold the text, in any case, in a field, the paragraph or its id; only those without a paragraph if asked."""
    rows = notes
    if paras is not None:
        known = paras.select("doc_id", F.col("id").alias("para"), F.col("text").alias("_para"))
        rows = rows.join(known, ["doc_id", "para"], "left_anti").withColumn("_para", F.lit("")) if orphans else rows.join(known, ["doc_id", "para"], "left")
    else:
        rows = rows.withColumn("_para", F.lit(""))
    if author:
        rows = rows.filter(t.strip("author") == author)
    if para:
        rows = rows.filter(F.col("para") == para)
    if needle := text.strip().lower():
        hay = F.lower(F.concat_ws(" ", *[t.plain(f) for f in ("text", "title", "author", "source")], t.plain("_para"), "para"))
        rows = rows.filter(hay.contains(needle))
    return rows.drop("_para")


def orphans(notes: DataFrame, paras: DataFrame) -> DataFrame:
    return notes.join(paras.select("doc_id", F.col("id").alias("para")), ["doc_id", "para"], "left_anti")


def renumbered(notes: DataFrame, order: Column) -> DataFrame:
    return notes.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id", "para").orderBy(order)) - 1)


def _place(doc_id, para: str, idx: int) -> Column:
    return (F.col("doc_id") == doc_id) & (F.col("para") == para) & (F.col("idx") == idx)


def added(notes: DataFrame, row: DataFrame, at: int | None = None) -> DataFrame:
    """notes with a row (doc_id, para and fields), at a place or the end of its paragraph."""
    new = cleaned(row).withColumn("idx", F.lit(float(at) - 0.5 if at is not None else 1e18))
    return renumbered(notes.withColumn("idx", F.col("idx").cast("double")).unionByName(new, allowMissingColumns=True), F.col("idx")).select(*notes.columns)


def updated(notes: DataFrame, doc_id, para: str, idx: int, **fields: str) -> DataFrame:
    here = _place(doc_id, para, idx)
    return notes.withColumns({k: F.when(here, F.lit(v)).otherwise(F.col(k)) for k, v in fields.items()})


def deleted(notes: DataFrame, gone: DataFrame) -> DataFrame:
    """notes without the rows at gone's (doc_id, para, idx)."""
    return renumbered(notes.join(gone, ["doc_id", "para", "idx"], "left_anti"), F.col("idx")).select(*notes.columns)


def duplicated(notes: DataFrame, doc_id, para: str, idx: int) -> DataFrame:
    copy = notes.filter(_place(doc_id, para, idx)).withColumn("idx", F.col("idx") + 0.5)
    return renumbered(notes.withColumn("idx", F.col("idx").cast("double")).unionByName(copy), F.col("idx")).select(*notes.columns)


def moved(notes: DataFrame, doc_id, para: str, idx: int, delta: int) -> DataFrame:
    """The note moved within its paragraph, as far as that goes."""
    here = _place(doc_id, para, idx)
    return renumbered(notes, F.when(here, F.col("idx") + delta + F.lit(0.5 if delta > 0 else -0.5)).otherwise(F.col("idx"))).select(*notes.columns)


def moved_to(notes: DataFrame, doc_id, para: str, idx: int, new_para: str) -> DataFrame:
    here = _place(doc_id, para, idx)
    order = F.col("_o")
    rows = notes.withColumn("_o", F.when(here, F.lit(1e18)).otherwise(F.col("idx"))).withColumn("para", F.when(here, F.lit(new_para)).otherwise(F.col("para")))
    return renumbered(rows, order).select(*notes.columns)


class Versions:
    """Undo and redo over immutable tables: the last hundred states."""

    def __init__(self, notes: DataFrame, depth: int = 100) -> None:
        self.states, self.at, self.depth = [notes], 0, depth

    @property
    def now(self) -> DataFrame:
        return self.states[self.at]

    def push(self, notes: DataFrame) -> DataFrame:
        self.states = [*self.states[: self.at + 1], notes][-self.depth - 1 :]
        self.at = len(self.states) - 1
        return notes

    def undo(self) -> DataFrame:
        self.at = max(0, self.at - 1)
        return self.now

    def redo(self) -> DataFrame:
        self.at = min(len(self.states) - 1, self.at + 1)
        return self.now


def without_exact_repeats(notes: DataFrame) -> DataFrame:
    """Of notes alike in paragraph and all fields, the first."""
    n = F.row_number().over(Window.partitionBy("doc_id", "para", *[t.plain(f) for f in FIELDS if f in notes.columns]).orderBy("idx"))
    return notes.withColumn("_n", n).filter("_n = 1").drop("_n")


def same_text(pairs: DataFrame, a: str, b: str, fuzzy: bool = True) -> DataFrame:
    """pairs with same: whether two texts are one note (equal when folded, or long and with a common run of nine tenths of the longer) and score, their similarity if it is at least SIMILAR, else perhaps 0. Without fuzzy only equal texts are the same, and the score is 1 or 0."""
    return _same_folded(pairs.withColumns({"_x": t.folded(a), "_y": t.folded(b)}), fuzzy).drop("_x", "_y")


def _same_folded(rows: DataFrame, fuzzy: bool) -> DataFrame:
    """same_text() of rows with the folded texts _x and _y."""
    if not fuzzy:
        same = (F.col("_x") == F.col("_y")) & (F.col("_x") != "")
        return rows.withColumns({"same": same, "score": same.cast("double")})
    ratio, run = sim.ratio_bound(F.col("_x"), F.col("_y")), sim.run_bound(t.words("_x"), F.col("_y"))
    rows = rows.withColumn("_s", sim.similarity(F.when(sim.may_reach(SIMILAR, ratio, run, F.col("_x"), F.col("_y")), F.col("_x")), "_y", SIMILAR, SAME_CHARS, SAME_RUN))
    low, high = F.least(F.length("_x"), F.length("_y")), F.greatest(F.length("_x"), F.length("_y"))
    same = ((F.col("_x") == F.col("_y")) & (F.col("_x") != "")) | ((low >= SAME_CHARS) & (F.col("_s.run") >= SAME_RUN * high))
    return rows.withColumns({"same": same, "score": F.col("_s.score")}).drop("_s")


def same_run(a: Column, b: Column) -> Column:
    """Whether two texts of at least SAME_CHARS have a common run of TENTHS tenths of the longer: one of the shorter one's few pieces of that length is in the longer."""
    first = F.length(a) <= F.length(b)
    low, high = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    need = F.ceil(F.length(high) * TENTHS / 10).cast("int")
    pieces = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - need + 1))
    return (F.length(low) >= F.greatest(F.lit(SAME_CHARS), need)) & F.exists(pieces, lambda i: F.contains(high, F.substring(low, i, need)))


def _pieces(norm: pd.Series) -> pd.DataFrame:
    """Of folded texts of SAME_CHARS at least: own, the piece of PIECE characters with the least hash in the middle eight tenths, and held, the pieces with the least hash of any stretch as long as the shortest middle of a text that may say the same."""
    own, held = [], []
    for text in norm:
        codes = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
        n, tenth, least = len(codes) - PIECE + 1, len(codes) // 10, max(SAME_CHARS, -(-len(codes) * TENTHS // 10))
        hashes = np.zeros(n, np.uint64)
        for j in range(PIECE):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        width = -(-8 * least // 10) - PIECE + 1  # over half of n: every stretch has the pieces from n - width to width
        left, right = np.minimum.accumulate(hashes[: n - width][::-1])[::-1], np.minimum.accumulate(hashes[width:])
        middle = hashes[n - width : width].min()
        stretches = np.minimum(middle, np.minimum(np.append(left, middle), np.insert(right, 0, middle)))
        own.append(hashes[tenth : len(codes) - tenth - PIECE + 1].min().view(np.int64))
        held.append(np.unique(stretches).view(np.int64))
    return pd.DataFrame({"own": np.array(own, np.int64), "held": held})


def alike(texts: DataFrame) -> DataFrame:
    """(doc_id, id, id2): different texts (doc_id, id, norm; each text once, ids short) of one document that say the same, each pair both ways.

    A common run of nine tenths leaves at most a tenth at either end, so the middle of one stands in the other, and with it the
    piece of the least hash, which is the least of a stretch of the other too. Only ids and hashes travel until a pair is compared.
    """
    long = cut(texts.filter(F.length("norm") >= SAME_CHARS).select("doc_id", "id", "norm"), "alike-texts")
    found = long.select("doc_id", "id", F.length("norm").alias("n"), F.pandas_udf(_pieces, "own long, held array<long>")("norm").alias("p"))
    found = cut(found.select("doc_id", "id", "n", "p.own", "p.held"), "alike-pieces")
    held = found.select("doc_id", F.col("id").alias("id2"), F.col("n").alias("n2"), F.explode("held").alias("own"))
    pairs = found.drop("held").join(held, ["doc_id", "own"]).filter("(n < n2 or (n = n2 and id < id2)) and 10 * n >= 9 * n2").select("doc_id", "id", "id2").distinct()
    both = pairs.join(long, ["doc_id", "id"]).join(long.select("doc_id", F.col("id").alias("id2"), F.col("norm").alias("norm2")), ["doc_id", "id2"])
    pairs = cut(both.filter(same_run(F.col("norm"), F.col("norm2"))).select("doc_id", "id", "id2"), "alike-pairs")
    return pairs.unionByName(pairs.select("doc_id", F.col("id2").alias("id"), F.col("id").alias("id2")))


def without_near_repeats(notes: DataFrame, order: str, least_chars: int = 40) -> DataFrame:
    """notes without those of more than so many folded characters that say the same as an earlier one of the document, by order, idx and para; whether that one stays or not."""
    rows = notes.withColumn("norm", t.folded("text")).withColumns({"_at": F.struct(order, "idx", "para"), "id": F.when(F.length("norm") > least_chars, F.md5("norm"))})
    firsts = cut(rows.filter("id is not null").groupBy("doc_id", "id").agg(F.min("_at").alias("_first"), F.first("norm").alias("norm")), "firsts")
    near = alike(firsts).join(firsts.select("doc_id", F.col("id").alias("id2"), F.col("_first").alias("_near")), ["doc_id", "id2"])
    known = firsts.drop("norm").join(near.groupBy("doc_id", "id").agg(F.min("_near").alias("_near")), ["doc_id", "id"], "left").select("doc_id", "id", F.least("_first", "_near").alias("_first"))
    return rows.drop("norm").join(known, ["doc_id", "id"], "left").filter(~F.coalesce(F.col("_first") < F.col("_at"), F.lit(False))).select(*notes.columns)


def merge_plan(store: DataFrame, incoming: DataFrame, fuzzy: bool = True) -> DataFrame:
    """incoming (doc_id, para, idx, fields) with kind new, duplicate, conflict or repeated, and the idx of the stored note that it repeats or clashes with.

    Within a paragraph, notes of one author are compared. A note that an earlier incoming one is the same as is repeated;
    one that is stored already is a duplicate; one like a stored note, the first in order, is a conflict. Without fuzzy only equal texts count, and nothing is a conflict.
    """
    rows = cleaned(incoming)
    author = lambda x: t.plain(f"{x}.author")
    on = lambda: (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.para") == F.col("b.para")) & (author("a") == author("b"))
    key = [F.col("a.doc_id").alias("doc_id"), F.col("a.para").alias("para"), F.col("a.idx").alias("idx")]
    both = [F.col("a._norm").alias("_x"), F.col("b._norm").alias("_y")]
    named = lambda notes: notes.select("doc_id", "para", "idx", "author", t.folded("text").alias("_norm"))  # noqa: E731 - each text is folded once, not in every pair
    ours = named(rows)
    inner = ours.alias("a").join(ours.alias("b"), on() & (F.col("b.idx") < F.col("a.idx"))).select(*key, *both)
    same = (F.col("_x") == F.col("_y")) & (F.col("_x") != "")
    repeated = inner.filter(same | same_run(F.col("_x"), F.col("_y")) if fuzzy else same).select("doc_id", "para", "idx").distinct().withColumn("_repeated", F.lit(True))
    pairs = ours.alias("a").join(named(cleaned(store)).alias("b"), on()).select(*key, *both, F.col("b.idx").alias("existing"))
    judged = _same_folded(pairs, fuzzy).groupBy("doc_id", "para", "idx").agg(F.min(F.when(F.col("same"), F.col("existing"))).alias("_twin"), F.min_by(F.when(F.col("score").between(SIMILAR, 0.999999999), F.struct("existing", "score")), F.when(F.col("score").between(SIMILAR, 0.999999999), F.col("existing"))).alias("_clash"))
    out = rows.join(repeated, ["doc_id", "para", "idx"], "left").join(judged, ["doc_id", "para", "idx"], "left")
    kind = F.when(F.col("_repeated"), "repeated").when(F.col("_twin").isNotNull(), "duplicate").when(F.col("_clash").isNotNull(), "conflict").otherwise("new")
    return out.withColumns({"kind": kind, "existing": F.when(kind == "duplicate", F.col("_twin")).when(kind == "conflict", F.col("_clash.existing")), "similarity": F.when(kind == "conflict", F.col("_clash.score"))}).drop("_repeated", "_twin", "_clash")


def merge_apply(store: DataFrame, plan: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The store after the plan. decisions (doc_id, para, idx, choice): keep (the default), take or both, for conflicts."""
    chosen = plan.join(decisions, ["doc_id", "para", "idx"], "left") if decisions is not None else plan.withColumn("choice", F.lit(None).cast("string"))
    take = chosen.filter("kind = 'conflict' and choice = 'take'").select("doc_id", "para", F.col("existing").alias("idx"), *[F.col(f).alias(f"_{f}") for f in FIELDS], F.lit(True).alias("_new"))
    kept = store.join(take, ["doc_id", "para", "idx"], "left")
    kept = kept.select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in FIELDS else F.col(c) for c in store.columns])
    more = chosen.filter("kind = 'new' or (kind = 'conflict' and choice = 'both')").select(*store.columns)
    both = kept.withColumn("_o", F.lit(0)).unionByName(more.withColumn("_o", F.lit(1)))
    return renumbered(both, F.struct("_o", "idx")).select(*store.columns)


def counts(notes: DataFrame) -> DataFrame:
    """(doc_id, notes, paragraphs, authors)."""
    author = F.nullif(t.strip("author"), F.lit(""))
    return notes.groupBy("doc_id").agg(F.count("*").alias("notes"), F.count_distinct("para").alias("paragraphs"), F.count_distinct(author).alias("authors"))


def rail(notes: DataFrame, paras: DataFrame) -> DataFrame:
    """(doc_id, para, n, position, opacity): density of notes along the document."""
    by = Window.partitionBy("doc_id")
    placed = paras.withColumn("position", (F.row_number().over(by.orderBy("ord")) - 1) * 100.0 / F.greatest(F.lit(1), F.count("*").over(by) - 1)).select("doc_id", F.col("id").alias("para"), "position")
    n = notes.groupBy("doc_id", "para").agg(F.count("*").alias("n"))
    return n.join(placed, ["doc_id", "para"]).withColumn("opacity", F.least(F.lit(1.0), 0.5 + 0.16 * F.col("n")))


def neighbours(noted: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """noted with previous and next item in order, around the ends."""
    by = Window.partitionBy(group).orderBy(order)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return noted.withColumns({"previous": F.coalesce(F.lag(item).over(by), F.last(item).over(whole)), "next": F.coalesce(F.lead(item).over(by), F.first(item).over(whole))})


def highlighted(paras: DataFrame, notes: DataFrame, authors: list[str]) -> DataFrame:
    """paras (doc_id, id) with shown: hl if a selected author (all, if none is) has a note on it, else dim if it has notes, else none."""
    hit = F.lit(True) if not authors else F.col("author").isin(*authors)
    marks = notes.groupBy("doc_id", F.col("para").alias("id")).agg(F.max(F.when(hit, 1).otherwise(0)).alias("_hit"))
    return paras.join(marks, ["doc_id", "id"], "left").withColumn("shown", F.when(F.col("_hit") == 1, "hl").when(F.col("_hit") == 0, "dim").otherwise("none")).drop("_hit")


def authors(notes: DataFrame) -> DataFrame:
    """(doc_id, author): who has notes, without blank names."""
    return notes.select("doc_id", t.strip("author").alias("author")).filter("author <> ''").distinct()


def targets(notes: DataFrame) -> DataFrame:
    """(doc_id, para, place): the paragraphs that have notes, numbered from 1 in the order of their first ones (para_ord)."""
    first = notes.groupBy("doc_id", "para").agg(F.min(F.struct("para_ord", "para")).alias("_o"))
    return first.select("doc_id", "para", F.row_number().over(Window.partitionBy("doc_id").orderBy("_o")).alias("place"))


def first_noted(paras: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, id): each document's first paragraph (doc_id, id, ord) that has a note."""
    return paras.join(notes.select("doc_id", F.col("para").alias("id")).distinct(), ["doc_id", "id"], "left_semi").groupBy("doc_id").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))


def plan_counts(plan: DataFrame) -> DataFrame:
    """(doc_id, new, duplicate, conflict, repeated) of a merge plan."""
    return plan.groupBy("doc_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("new", "duplicate", "conflict", "repeated")])


def conflict_reason(author: str | Column, similarity: str | Column) -> Column:
    share = F.bround(t.col(similarity) * 100, 0).cast("int").cast("string")
    return F.concat(F.coalesce(F.nullif(t.strip(author), F.lit("")), F.lit("the same author")), F.lit(" already has a note on this paragraph that is "), share, F.lit("% the same — probably an edit of it"))


def short(text: str | Column, limit: int = 46) -> Column:
    """The text on one line, cut to so many characters with the mark of it."""
    one = t.squeezed(t.plain(text))
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.regexp_replace(F.left(one, F.lit(limit - 1)), r"(?U)\s+$", ""), F.lit("…")))


def merge_entries(store: DataFrame, incoming: DataFrame, fuzzy: bool = True) -> DataFrame:
    """store with the incoming notes behind those of their paragraph, but for those without text and those that are the same as a stored or an earlier incoming one of that paragraph and author."""
    return merge_apply(store, merge_plan(store, incoming.filter(t.strip("text") != ""), fuzzy).withColumn("kind", F.when(F.col("kind") == "conflict", "new").otherwise(F.col("kind"))))


def incoming_by_id(items: DataFrame) -> DataFrame:
    """items (doc_id, para, text, quote) with para as an id, placed (whether a note without its document's text can be put by that alone) and short, what to call it by."""
    para = t.strip(t.plain("para"))
    named = F.when((para != "") & ~para.startswith("para-"), F.concat(F.lit("para-"), para)).otherwise(para)
    called = F.left(F.coalesce(F.nullif(t.plain("text"), F.lit("")), t.plain("quote")), F.lit(70))
    return items.withColumns({"short": called, "placed": (named != "") & (t.plain("text") != ""), "para": named})


def statistics(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, headings, annotated, notes, unplaced, authors) of blocks (doc_id, id, kind) and their notes; unplaced: notes whose paragraph isn't there."""
    ids = blocks.filter("kind = 'para'").select("doc_id", F.col("id").alias("para")).distinct().withColumn("_there", F.lit(True))
    placed = notes.join(ids, ["doc_id", "para"], "left")
    there = F.col("_there").isNotNull()
    by = placed.groupBy("doc_id").agg(F.count_distinct(F.when(there, F.col("para"))).alias("annotated"), F.count(F.when(there, 1)).alias("notes"), F.count(F.when(~there, 1)).alias("unplaced"), F.count_distinct(F.nullif(t.strip("author"), F.lit(""))).alias("authors"))
    kinds = blocks.groupBy("doc_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(c) for k, c in (("para", "paragraphs"), ("heading", "headings"))])
    return kinds.join(by, "doc_id", "left").fillna(0, ["annotated", "notes", "unplaced", "authors"])


def attached_share(stats: DataFrame, least: float = 0.6) -> DataFrame:
    """stats with share, the notes that have a place, and enough, whether that is so much at least (documents without notes have enough)."""
    share = F.col("notes") / (F.col("notes") + F.col("unplaced"))
    return stats.withColumns({"share": share, "enough": F.coalesce(share >= least, F.lit(True))})
