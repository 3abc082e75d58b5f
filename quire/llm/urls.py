"""URL filter: rules first, then the log-likelihood ratio of two smoothed variable-order Markov models of characters.

URLs that a rule allows or blocks train one model each, of contexts of 4 to 0 characters, mixed by Witten-Bell weights.
All is counted and looked up by DataFrame operations over the distinct 5-character pieces of the corpus; what a URL gets is
the mean over its characters, query string and all. The threshold is the one that best parts the rules' URLs that were held
back from training.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import cut, join_small

#: (verdict, host, start of the path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Longest context; of labelled URLs one in so many is held back; fixed-point unit of scores (sums are exact in any order).
ORDER, HELD_BACK, UNIT = 4, 5, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end. Null or no ://: both empty."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule for the host or a domain above it whose path starts the path; of equal lengths, a block first. Both null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _grams(text: Column) -> Column:
    """The pieces of ORDER + 1 characters that end at each character and at the end of the text."""
    chars = F.split(F.concat(F.lit("\u0002" * ORDER), text, F.lit("\u0003")), "")
    pieces = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - ORDER), lambda i: F.array_join(F.slice(x, i, F.lit(ORDER + 1)), ""))
    return F.transform(F.array(chars), pieces)[0]  # so that the text is split once


def _ratios(counts: DataFrame) -> DataFrame:
    """counts (gram, n_allow, n_block) to (gram, ratio): log of its last character's chance after the rest, under the allowed over the blocked URLs."""
    kinds = ("allow", "block")
    known = None
    for order in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - order, order + 1)
        n = counts.groupBy(tail.alias("tail")).agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds]).withColumn("context", F.substring("tail", 1, order))
        contexts = n.groupBy("context").agg(*[F.sum(f"n_{k}").alias(f"all_{k}") for k in kinds], *[F.count(F.when(F.col(f"n_{k}") > 0, 1)).alias(f"kinds_{k}") for k in kinds])
        n = n.join(contexts, "context")
        if known is None:
            alphabet = max(1, n.count())
            n = n.withColumns({f"less_{k}": F.lit(1.0 / alphabet) for k in kinds})
        else:
            n = n.withColumn("shorter", F.substring("tail", 2, order)).join(known, "shorter")
        chance = {k: F.when(F.col(f"all_{k}") > 0, (F.col(f"n_{k}") + F.col(f"kinds_{k}") * F.col(f"less_{k}")) / (F.col(f"all_{k}") + F.col(f"kinds_{k}"))).otherwise(F.col(f"less_{k}")) for k in kinds}
        known = cut(n.select(F.col("tail").alias("shorter"), *[chance[k].alias(f"less_{k}") for k in kinds]), f"order-{order}")
    return known.select(F.col("shorter").alias("gram"), F.round((F.log("less_allow") - F.log("less_block")) * UNIT).cast("long").alias("ratio"))


def _text_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (url; any more columns are kept) with host, path, rule, verdict (allow or block) and score.

    score: mean log-likelihood difference a character, allowed less blocked, of the whole url; a null url is the empty
    text. Where no rule fits, the verdict is allow if the score reaches the threshold (of thresholds that part the held-back
    URLs equally well, the one nearest to 0, then the lower). Without URLs of both kinds the threshold is 0 and every score
    0, so all is allowed. Repeated rows get the same values. Columns of pages named like the added ones are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    key = F.md5(url)
    slim = pages.select(url.alias("__url"), key.alias("__key"), host.alias("__host"), path.alias("__path")).withColumn("__fixed", verdict)
    slim = slim.withColumn("__back", _text_hash(F.col("__url")) % HELD_BACK == 0)
    of = lambda kind: F.count(F.when((F.col("__fixed") == kind) & ~F.col("__back"), 1))
    counts = slim.select("__fixed", "__back", F.explode(_grams(F.col("__url"))).alias("gram")).groupBy("gram").agg(of("allow").alias("n_allow"), of("block").alias("n_block"))
    ratios = _ratios(cut(counts, "grams"))

    pieces = slim.select("__key", F.explode(_grams(F.col("__url"))).alias("gram")).groupBy("__key", "gram").agg(F.count("*").alias("n"))
    sums = join_small(pieces, ratios, "gram", "inner").groupBy("__key").agg((F.sum(F.col("ratio") * F.col("n")).cast("double") / F.sum("n") / UNIT).alias("score"))
    scores = cut(sums, "scores")

    held = slim.filter(F.col("__back") & F.col("__fixed").isNotNull()).groupBy("__key").agg(F.count(F.when(F.col("__fixed") == "allow", 1)).alias("a"), F.count(F.when(F.col("__fixed") == "block", 1)).alias("b"))
    bins = held.join(scores, "__key").groupBy((F.floor(F.col("score") * 100 + 0.5) / 100).alias("at")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    below, whole = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each hundredth
    gain = F.coalesce(F.sum("b").over(below), F.lit(0)) / F.sum("b").over(whole) - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(whole)
    both = bins.filter("a > 0 or b > 0").withColumns({"na": F.sum("a").over(whole), "nb": F.sum("b").over(whole)}).filter("na > 0 and nb > 0")
    top = both.withColumn("gain", gain).orderBy(F.col("gain").desc(), F.abs("at"), "at").select("at").first()
    threshold = float(top["at"]) - 0.005 if top else 0.0
    out = join_small(pages.withColumns({"__host": host, "__path": path, "__key": key}), scores, "__key", "left")
    out = out.withColumns({"rule": rule, "__fixed": verdict})
    return out.select(*pages.columns, F.col("__host").alias("host"), F.col("__path").alias("path"), "rule", F.coalesce("__fixed", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")
