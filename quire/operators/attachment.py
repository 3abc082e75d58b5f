"""What becomes of notes once their targets are known: attached, a duplicate, absorbed, or unplaced.

Notes are taken in order, the first source first. A note falls if an earlier one that stayed says the same, so what one note
does to the next depends on what happened to it. Notes of one text are a class, of which only the first matters to others.
Classes that say the same are linked; a class whose earlier neighbours have all fallen stays, one with an earlier neighbour that
stays falls, and rounds go on until every class is decided: the first independent set in the order of the notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..store import cut
from .notes import FIELDS, SAME_CHARS, alike

#: Folded characters beyond which a note is compared with others.
LONG = 40


def first_independent(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node) of nodes (node, at) that stay: those without an earlier neighbour that stays. links: (node, other), both ways; at tells no two nodes alike."""
    earlier = links.join(nodes.select("node", "at"), "node").join(nodes.select(F.col("node").alias("other"), F.col("at").alias("_at")), "other").filter("_at < at").select("node", "other")
    open_ = cut(earlier, "open")  # of undecided nodes, the earlier neighbours that are undecided too
    fallen = None
    while not open_.isEmpty():
        waiting = open_.select("node").distinct()
        stay = cut(open_.select(F.col("other").alias("node")).distinct().join(waiting, "node", "left_anti"), "stay")  # decided to stay: nothing earlier is open
        fall = cut(open_.join(stay.select(F.col("node").alias("other")), "other", "left_semi").select("node").distinct(), "fall")
        fallen = fall if fallen is None else fallen.unionByName(fall)
        gone = fall.select(F.col("node").alias("other"))
        open_ = cut(open_.join(fall, "node", "left_anti").join(gone, "other", "left_anti").join(stay.select(F.col("node").alias("other")), "other", "left_anti"), "open")
    left = nodes.select("node")
    return left if fallen is None else left.join(fallen, "node", "left_anti")


def settled(notes: DataFrame, by_origin: bool = False) -> DataFrame:
    """notes (doc_id, ord, target, origin, text; author, title and source if there are any) with outcome.

    ord tells the order in a document and no two notes alike. A note with a target is attached, or a duplicate of an earlier one
    that is attached: one with the same target and fields, or, beyond LONG folded characters, one that says the same, wherever
    it is. by_origin: only one of another origin counts for the latter, so that what one source says twice stays. A note
    without a target is absorbed if an earlier attached one says the same, else unplaced. Notes without text are attached or
    unplaced as they are. Extra columns stay.
    """
    fields = F.md5(F.to_json(F.struct(*[(t.plain(f) if f in notes.columns else F.lit("")).alias(f) for f in FIELDS])))
    rows = notes.withColumn("_norm", t.folded("text")).withColumns({"_row": F.monotonically_increasing_id(), "_n": F.length("_norm"), "_same": F.md5("_norm"), "_class": F.lit("") if not by_origin else t.plain("origin"), "_fields": fields})
    rows = cut(rows.drop("_norm"), "notes")  # texts are named by their digests from here on
    slim = rows.select("_row", "doc_id", "ord", "target", "_n", "_same", "_class", "_fields")
    placed = slim.filter("target is not null")
    texts = rows.filter(F.col("_n") >= SAME_CHARS).groupBy("doc_id", F.col("_same").alias("id")).agg(F.first("text").alias("text")).select("doc_id", "id", t.folded("text").alias("norm"))
    same = alike(texts)
    classes = cut(placed.filter(F.col("_n") > LONG).groupBy("doc_id", "_same", "_class").agg(F.min("ord").alias("at")).withColumn("node", F.sha2(F.to_json(F.struct("doc_id", "_same", "_class")), 256)), "classes")
    of = lambda n: classes.select("doc_id", F.col("_same").alias(n), F.col("_class").alias(f"_c_{n}"), F.col("node").alias(f"_n_{n}"), F.col("at").alias(f"_at_{n}"))
    links = same.join(of("id"), ["doc_id", "id"]).join(of("id2"), ["doc_id", "id2"])
    if by_origin:
        equal = of("id").join(of("id2").withColumn("id", F.col("id2")), ["doc_id", "id"])
        links = links.unionByName(equal.select(*links.columns)).filter("_c_id <> _c_id2")
    links = cut(links.select("doc_id", F.col("_n_id").alias("node"), F.col("_n_id2").alias("other"), F.col("_at_id2").alias("at")), "links")
    stay = cut(first_independent(classes.select("node", F.struct("doc_id", "at").alias("at")), links.select("node", "other")), "classes-stay")
    until = links.join(stay.withColumnRenamed("node", "other"), "other", "left_semi").groupBy("node").agg(F.min("at").alias("_until"))  # what is said from there on is said already
    known = classes.join(until, "node", "left").select("doc_id", "_same", "_class", "at", "_until")
    marked = placed.join(known, ["doc_id", "_same", "_class"], "left")
    again = F.col("ord") >= F.col("_until") if by_origin else (F.col("ord") > F.col("at")) | (F.col("ord") >= F.col("_until"))
    marked = marked.withColumn("_said", F.coalesce(again, F.lit(False))).drop("at", "_until")
    first = F.row_number().over(Window.partitionBy("doc_id", "target", "_fields", "_said").orderBy("ord")) == 1
    judged = cut(marked.withColumn("outcome", F.when(F.col("_said") | ~first, "duplicate").otherwise("attached")).select("_row", "doc_id", "ord", "_n", "_same", "outcome"), "judged")
    there = judged.filter("outcome = 'attached' and _n > 0").groupBy("doc_id", "_same").agg(F.min("ord").alias("_said_at"))
    near = same.join(there.withColumnRenamed("_same", "id2"), ["doc_id", "id2"]).select("doc_id", F.col("id").alias("_same"), "_said_at")
    there = there.unionByName(near).groupBy("doc_id", "_same").agg(F.min("_said_at").alias("_said_at"))
    lost = slim.filter("target is null").join(there, ["doc_id", "_same"], "left").select("_row", F.when(F.col("_said_at") < F.col("ord"), "absorbed").otherwise("unplaced").alias("outcome"))
    return rows.join(judged.select("_row", "outcome").unionByName(lost), "_row").select(*notes.columns, "outcome")
