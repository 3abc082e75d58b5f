"""Mixing sources to target weights.

Every document gets a hash-random key. The keys of a source fall into equal ranges, ranges into coarser groups; sums of
word counts over ranges and prefix sums over both levels say in which range each source's budget ends, and only the rows
of that range are sorted. What is moved is one row per range, never a text; a hot source has more ranges, not larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import WORD, cut, join_small

#: Rows of a source per range of keys, and ranges per group.
RANGE_ROWS, GROUP_RANGES = 64, 256
_NO_ID = -(1 << 63)


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Adds weight and target to a table of (skey, source, source_size, n_docs), one row per source.

    Targets are proportional to the weights and sum to all sizes, but none is above cap times its source's size; what
    is over is shared again by weight among the rest, in rounds, until none is above.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row per source
    weighed = cut(sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))), "sources")
    level, full = 0.0, -1
    while True:
        above = (F.col("weight") * level > F.col("source_size") * cap) if full >= 0 else F.lit(False)
        row = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("source_size"))).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("w"), F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == full or not row["w"]:
            break
        full, level = row["n"], (float(row["all"] or 0) - cap * float(row["capped"] or 0)) / row["w"]
    return weighed.withColumn("target", F.least(F.col("weight") * level, F.col("source_size") * cap))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: str = "") -> DataFrame:
    """docs (doc_id, text, source; any more columns are kept) with size, source_size, target, taken and copies.

    The sources in code-point order, null last, have the weights, which repeat. taken: words that the mix takes of the
    document, repeats counted; copies: how often all of it is taken. The document at which a budget ends is taken in
    part: taken - copies * size words. Rows alike in doc_id and size share such a rest evenly. A null text has no
    words and is never taken; a null doc_id sorts as an empty one. The same rows give the same result in any order.
    Columns of docs named like the added ones are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "copies")
    keyed = docs.select(
        *docs.columns, word_count("text").alias("size"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("_skey"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"),
    )
    small = cut(keyed.select("_skey", "source", "size", "_key", "_id"), "sized")
    plan = targets(small.groupBy("_skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("_docs")), weights, cap)
    budget = F.floor(F.col("target") + 0.5)
    plan = plan.select("_skey", "source_size", "target", "_docs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("_epochs"))
    plan = cut(plan.withColumn("_rest", budget - F.col("_epochs") * F.col("source_size")).withColumn("_ranges", F.ceil(F.col("_docs") / RANGE_ROWS)), "plan")

    number = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    ranged = join_small(small.drop("source"), plan.select("_skey", "_ranges", "_rest").filter("_rest > 0"), "_skey", "inner").withColumn("_range", F.floor(number * F.col("_ranges") / F.lit(1 << 32)))
    sums = ranged.groupBy("_skey", "_range").agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest")).withColumn("_group", F.floor(F.col("_range") / GROUP_RANGES))
    sums = cut(sums, "range-sums")
    before = lambda keys, by: F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("_skey", "_group").agg(F.sum("_sum").alias("_sum")).withColumn("_before_group", before(["_skey"], "_group")).drop("_sum")
    within = sums.withColumn("_before", before(["_skey", "_group"], "_range"))
    ends = within.join(groups, ["_skey", "_group"]).withColumn("_before", F.col("_before") + F.col("_before_group"))
    ends = cut(ends.filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_sum"))).select("_skey", "_range", "_before"), "ends")

    alike = join_small(ranged, ends, ["_skey", "_range"], "inner").groupBy("_skey", "_key", "_id", "size").agg(F.count("*").alias("_n"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
    order = Window.partitionBy("_skey").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("_before", F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_n")).over(order), F.lit(0)))
    last = alike.filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("size") * F.col("_n")))
    last = last.select("_skey", F.struct("_key", "_id", "size").alias("_cut"), F.floor((F.col("_rest") - F.col("_before")) / F.col("_n")).alias("_share"))
    plan = cut(plan.drop("_docs", "_ranges", "_rest").join(last, "_skey", "left"), "cuts")

    me = F.struct("_key", "_id", "size")
    copies = F.col("_epochs") + F.when(me < F.col("_cut"), 1).otherwise(0)
    out = join_small(keyed, plan, "_skey", "left").withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.when(me == F.col("_cut"), F.col("_share")).otherwise(0)).select(*docs.columns, "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: str = "") -> DataFrame:
    """The documents of the mix, with the columns of docs: each as often as it is taken, the last of a source cut after the words taken of it.

    What stands between and before the words of a cut text stays as it is. Documents without words (null, empty or blank
    texts) take no part in a mix of words and are left out. Rows with null or repeated ids are rows like others.
    """
    taken = mix(docs, weights, cap, seed).filter("taken > 0")
    rest = (F.col("taken") - F.col("copies") * F.col("size")).cast("int")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    texts = F.concat(F.array_repeat(F.col("text"), F.col("copies").cast("int")), F.when(rest > 0, F.array(F.array_join(F.slice(words, F.lit(1), rest), ""))).otherwise(F.array().cast("array<string>")))
    out = taken.withColumn("text", F.explode(texts))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
