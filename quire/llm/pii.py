"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, and a trained span classifier decides.

Everything is column expressions, windows and aggregates. Each pattern's pieces and matches become rows, whose running
lengths give positions; labelers (form, checksum, gazetteer, context, borders) vote yes, no or not at all; the counts of
vote patterns over the corpus give each labeler's reliability by expectation-maximisation; its posteriors train a naive
Bayes span classifier over span features. Spans of the base patterns always stay; the classifier decides on the wider forms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import cut, join_small

KINDS = ("email", "ip", "card", "phone")
# Java patterns that match what the plain ones match, in linear time: a match begins where the last one ended or a run begins.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 14 to 19 digits with at most one space or hyphen between two; shorter and longer runs fail as a whole.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wider forms: they are candidates only.
WIDE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("phone", r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
)
#: What a text must hold for a pattern to be tried: of the base patterns, then of the wider ones.
HINTS = ("@", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){13}", r"\+[0-9]", r"[\[(]at[\])]", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", r"[0-9]{3}[.-][0-9]{4}")
#: (kind, pattern, whether it is a wider form).
PATTERNS = tuple(zip(KINDS, (EMAIL, IP, CARD, PHONE), (False,) * 4, strict=True)) + tuple((kind, pattern, True) for kind, pattern in WIDE)
# Gazetteer and context words (fixed values).
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|nl|uk|us|ch|at|be|ca|au|mil|int)$"
CUES = r"(?i)(?:e-?mail|mail|contact|correo|courriel|phone|tel|mobile|call|fax|telefon|numero|ip|address|host|server|card|visa|master|amex|kart|carte|tarjeta)[\x20:.=#-]{0,3}$"
NO_CUES = r"(?i)(?:order|invoice|isbn|issn|serial|version|build|token|sku|part|ref|id|no|nr)[\x20:.=#-]{0,3}$"
LABELERS, ROUNDS = ("form", "check", "gazetteer", "context", "borders"), 12


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(F.regexp_replace(p, "^0+", ""), F.lit(4)).try_cast("int"), F.lit(0)) <= 255))


def _passes(kind: str, hit: Column) -> Column:
    """The base rule's check."""
    if kind == "card":
        return luhn(_digits(hit))
    if kind == "ip":
        return _octets(hit)
    return F.length(_digits(hit)).between(10, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, wide: bool, hit: Column, left: Column, right: Column) -> list[Column]:
    """1 yes, 0 no, 2 abstains; in the order of LABELERS."""
    yes, no, none = F.lit(1), F.lit(0), F.lit(2)
    digits = _digits(hit)
    form = none if wide else F.when(_passes(kind, hit), yes).otherwise(no)
    check = {
        "email": F.when(F.length(hit) <= 254, yes).otherwise(no), "ip": none if wide else F.when(_octets(hit) & ~hit.startswith("0"), yes).otherwise(no),
        "card": F.when(luhn(digits), yes).otherwise(no), "phone": F.when(F.length(digits).between(10, 15), yes).otherwise(no),
    }[kind]
    gazetteer = {
        "email": F.when(hit.rlike(DOMAINS), yes).otherwise(none), "ip": F.when(hit.rlike(r"^(?:0|127|255)\."), no).otherwise(none),
        "card": F.when(digits.rlike(r"^[3456]"), yes).otherwise(no), "phone": F.when(digits.rlike(r"^(?:000|123|999)"), no).otherwise(none),
    }[kind]
    context = F.when(left.rlike(CUES), yes).when(left.rlike(NO_CUES), no).otherwise(none)
    borders = F.when(left.rlike(r"[\p{L}\p{N}_]$") | right.rlike(r"^[\p{L}\p{N}_]"), no).otherwise(yes)
    return [form, check, gazetteer, context, borders]


def _pieces(text: Column) -> Column:
    """array<struct<pattern, n, l, r, hit>> of a text: by pattern, each piece between matches (its length and ends) and the match after it; the last has none."""
    none = F.array().cast("array<struct<pattern:int,n:int,l:string,r:string,hit:string>>")

    def parts(k: int, pattern: str, hint: str) -> Column:
        pieces = F.transform(F.split(text, pattern, -1), lambda x: F.struct(F.length(x).alias("n"), F.right(x, F.lit(24)).alias("l"), F.left(x, F.lit(2)).alias("r")))
        both = F.zip_with(pieces, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x, hit: F.struct(F.lit(k).alias("pattern"), x["n"].alias("n"), x["l"].alias("l"), x["r"].alias("r"), hit.alias("hit")))
        return F.when(text.contains(hint) if len(hint) == 1 else text.rlike(hint), both).otherwise(none)

    return F.concat(*[parts(k, pattern, hint) for k, ((_, pattern, _), hint) in enumerate(zip(PATTERNS, HINTS, strict=True))])


def _by_pattern(of) -> Column:
    """of(kind, wide), for the row's pattern."""
    out = F.lit(None)
    for k, (kind, _, wide) in enumerate(PATTERNS):
        out = F.when(F.col("pattern") == k, of(kind, wide)).otherwise(out)
    return out


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (text; null: empty) with a row number, `__row`, and `__raw`, empty where there is no candidate; and the candidate spans.

    The spans' columns: __row, start, kind, end (code points, end exclusive), base, votes, features.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__raw", _pieces(text)), "pieces")
    order = Window.partitionBy("__row", "pattern").orderBy("pos")
    before = F.sum(F.col("n") + F.coalesce(F.length("hit"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = numbered.select("__row", F.posexplode("__raw").alias("pos", "x")).select("__row", "pos", "x.*")
    rows = rows.withColumns({"start": (F.coalesce(before, F.lit(0)) + F.col("n")).cast("long"), "right": F.coalesce(F.lead("r").over(order), F.lit(""))}).filter(F.col("hit").isNotNull())
    hit, left, right = F.col("hit"), F.col("l"), F.col("right")
    kind = _by_pattern(lambda kind, _: F.lit(KINDS.index(kind)))
    name = _by_pattern(lambda kind, _: F.lit(kind))
    votes = _by_pattern(lambda kind, wide: F.concat(*[v.cast("string") for v in _votes(kind, wide, hit, left, right)]))
    base = _by_pattern(lambda kind, wide: F.lit(False) if wide else _passes(kind, hit))
    rows = rows.select("__row", "start", kind.alias("kind"), (F.col("start") + F.length("hit")).cast("long").alias("end"), base.alias("base"), votes.alias("votes"), name.alias("name"), "hit", F.col("l").alias("left"), "right", (F.col("pattern") >= len(KINDS)).cast("int").alias("wide"))
    rows = rows.withColumn("digits", F.length(_digits(hit)))
    size = F.least(F.length(hit), F.lit(40))
    marks = [("length", size - size % 4), ("digits", F.least("digits", F.lit(20))), ("left", F.right("left", F.lit(1)).rlike(r"^[\p{L}\p{N}]").cast("int")), ("right", F.col("right").rlike(r"^[\p{L}\p{N}]").cast("int"))]
    features = F.array(*[F.concat("name", F.lit(f".{m}."), value.cast("string")) for m, value in marks], F.concat("name", F.lit(".form."), F.col("wide").cast("string"), F.lit("."), "votes"))
    return numbered, cut(rows.select("__row", "start", "kind", "end", "base", "votes", features.alias("features")), "candidates")


def numbers(values: list[float]) -> Column:
    """The values as one constant array; code that reads it is the same for all values, and so compiled once."""
    return F.transform(F.split(F.lit(",".join(map(repr, values))), ","), lambda x: x.cast("double"))


def reliabilities(patterns: list[tuple[int, str, int]], rounds: int = ROUNDS) -> Column:
    """The chance that a span with these votes is personal data, as an expression over kind and votes.

    patterns (kind, votes, spans with them): len(KINDS) * 3 ** len(LABELERS) at most, whatever the corpus.
    """
    prior = [0.8] * len(KINDS)
    rate = [{"1": (0.8, 0.3), "0": (0.1, 0.6), "2": (0.1, 0.1)} for _ in LABELERS]  # chance of each vote for a true and a false span
    for _ in range(rounds):
        kinds = [[1.0, 1.0] for _ in KINDS]
        seen = [{v: [1.0, 1.0] for v in "012"} for _ in LABELERS]
        for kind, votes, n in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(r[v][0] / r[v][1]) for r, v in zip(rate, votes, strict=True))
            p = 1 / (1 + math.exp(-odds))
            for side, share in enumerate((p, 1 - p)):
                kinds[kind][side] += n * share
                for labeler, vote in zip(seen, votes, strict=True):
                    labeler[vote][side] += n * share
        prior = [min(max(yes / (yes + no), 0.01), 0.99) for yes, no in kinds]
        rate = [{v: tuple(x[v][side] / sum(x[w][side] for w in "012") for side in (0, 1)) for v in "012"} for x in seen]
    weights = numbers([math.log(p / (1 - p)) for p in prior] + [math.log(r[v][0] / r[v][1]) for r in rate for v in "012"])
    odds = F.get(weights, F.col("kind"))
    for i in range(len(LABELERS)):
        odds = odds + F.get(weights, len(KINDS) + 3 * i + F.substring("votes", i + 1, 1).cast("int"))
    return 1 / (1 + F.exp(-odds))


def _classifier(found: DataFrame) -> dict[str, float]:
    """Log odds of each span feature, and of no feature under the name "", from the spans' posteriors."""
    patterns = sorted(tuple(r) for r in found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect())
    weighed = found.withColumn("p", reliabilities(patterns)).select(F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature"), "p")
    rows = weighed.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # lengths, digits, votes: some hundreds at most
    yes, no = next(((r["yes"], r["no"]) for r in rows if not r["feature"]), (0.0, 0.0))
    base = math.log((yes + 1) / (no + 1))
    if not rows:
        return {"": 0.0}
    return {r["feature"]: base if not r["feature"] else round(math.log((r["yes"] + 1) / (r["no"] + 1)) - base, 6) for r in rows}


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with __row and __raw; and the spans that are base or that the classifier accepts: __row, start, kind, end, base."""
    numbered, found = candidates(docs)
    weights = _classifier(found)
    known = F.map_from_arrays(F.split(F.lit("\n".join(weights)), "\n"), numbers(list(weights.values())))  # some hundred entries
    score = F.aggregate("features", F.lit(weights.get("", 0.0)), lambda a, f: a + F.coalesce(F.try_element_at(known, f), F.lit(0.0)))
    kept = found.filter(F.col("base") | (score > 0)).groupBy("__row", "start", "kind", "end").agg(F.max("base").alias("base"))
    return numbered, cut(kept, "spans")


def marked(docs: DataFrame) -> DataFrame:
    """docs (text; null: empty; any more columns are kept, but text, base and spans) with base and spans: arrays of struct<start, kind, end>, kind an index into KINDS.

    start and end are code points, end exclusive; both lists are in the order of start, kind and end. spans holds all of
    base. Rows are marked each by itself: null or repeated ids don't matter.
    """
    numbered, found = _spans(docs.drop("base", "spans"))
    span = F.struct("start", "kind", "end")
    lists = found.groupBy("__row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = join_small(numbered.drop("__raw", "text"), cut(lists, "lists"), "__row", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("base", "spans")}).drop("__row")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts of base spans by kind, the hash of their list, and all spans. A null text is empty; null and repeated ids are reported as they are."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    slim = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = marked(docs.select("doc_id", slim.alias("text")))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span, overlapping ones as one, replaced by its first kind in brackets; the columns of docs, n_chars renewed. A null text becomes empty."""
    numbered, found = _spans(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    order = Window.partitionBy("__row").orderBy("start", "kind", "end")
    high = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = found.withColumn("head", (F.col("start") >= high).cast("int")).withColumn("run", F.sum("head").over(order))
    runs = runs.groupBy("__row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind", "end")).alias("kind"))
    at = F.coalesce(F.lag("end").over(Window.partitionBy("__row").orderBy("start")), F.lit(0))
    steps = runs.withColumn("at", at).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "at", "kind"))).alias("__steps"), F.max("end").alias("__end"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    some = join_small(numbered.filter(F.size("__raw") > 0), cut(steps, "steps"), "__row", "left")

    def replaced(chars: Column) -> Column:  # of the text's characters, as one value, so that each step copies its own part only
        part = lambda a, n: F.array_join(F.slice(chars, (a + 1).cast("int"), n.cast("int")), "")
        return F.concat(F.array_join(F.transform("__steps", lambda x: F.concat(part(x["at"], x["start"] - x["at"]), F.get(names, x["kind"]))), ""), part(F.col("__end"), F.size(chars)))

    text = F.when(F.col("__steps").isNotNull(), F.transform(F.array(F.split("text", "")), replaced)[0]).otherwise(F.col("text"))
    out = some.withColumn("text", text).select(*docs.columns).unionByName(numbered.filter(F.size("__raw") == 0).select(*docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out
