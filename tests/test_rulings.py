"""Numbered paragraphs and their formula, against the rows taken one by one."""

import random
import re

from pyspark.sql import functions as F

from quire.operators import notes, rulings

PAGES = re.compile(r"\b\d{1,4}\s*-\s*\d{1,4}\b\s*$")


def begin(rows):
    paras = [r for r in rows if r[2] == "para"]
    best = None
    for k, r in enumerate(paras):
        if not (r[3] or "").strip().startswith("1."):
            continue
        chunk = paras[k : k + 25]
        digits = [re.sub("[^0-9]", "", x[3] or "") for x in chunk]
        score = (sum(d != "" and int(d) == i for i, d in enumerate(digits, 1)), sum(len(x[4] or "") for x in chunk) / len(chunk), -sum(bool(PAGES.search((x[4] or "").strip())) for x in chunk))
        if best is None or score > best[0]:
            best = score, r[1]
    return best[1] if best else rows[0][1]


def test_body_begins_at_the_best_run(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(30):
        for i in range(rng.randrange(1, 90)):
            label = rng.choice([f"{i % 13 + 1}.", f"{i % 13 + 1}.", "1.", "", None, "1.2", "(3)"])
            rows.append((doc, i, rng.choice(["para", "para", "para", "heading"]), label, rng.choice(["Some text of it", "Contents 3-4", None, "", "Longer text that goes on for a while"])))
    table = spark.createDataFrame(rows, "doc_id int, ord int, row_type string, label string, text string")
    got = {r["doc_id"]: r["ord"] for r in rulings.body_begin(table.repartition(3)).collect()}
    assert got == {d: begin([r for r in rows if r[0] == d]) for d in range(30)}


def formula(lines):
    one = next((i for i, x in enumerate(lines) if re.match(r"^\s*(\d{1,4})\.\s+(.*\S)\s*$", x.strip()) and int(x.strip().split(".")[0]) == 1), None)
    block = []
    for x in lines[max(0, one - 140) : one] if one is not None else ():
        s = " ".join(x.split())
        if s and (any(s.lower().startswith(f.lower()) for f in rulings.FORMULAS) or (block and block[-1].lower().startswith(rulings.OPEN_FORMULAS) and len(s) <= 260 and not PAGES.search(s))):
            block.append(s)
    return [s for i, s in enumerate(block) if i == 0 or block[i - 1] != s]


def test_lead_in(spark):
    rng = random.Random(7)
    some = ["The International Court of Justice,", "composed as above,", "Having regard to Article 48", "having  regard to the Rules", "After deliberation,", "after deliberation again", "goes on here", "x" * 300, "listed 3-4", "", "Makes the following Order:", "Body text"]
    docs = {d: [rng.choice(some) for _ in range(rng.randrange(0, 200))] + rng.choice([[" 1.  First."], ["1. x", "After deliberation,"], ["11. no"], []]) for d in range(40)}
    table = spark.createDataFrame([(d, i, x) for d, xs in docs.items() for i, x in enumerate(xs)], "doc_id int, idx int, text string")
    got = {r["doc_id"]: r["lead"] for r in rulings.lead_in(table.repartition(3)).collect()}
    assert got == {d: x for d, xs in docs.items() if (x := formula(xs))} and len(got) > 10
    rows = table.select("doc_id", F.col("idx").alias("ord"), F.lit("para").alias("row_type"), F.lit("1.").alias("label"), "text")
    assert rulings.body_with_lead(rows, table).filter("row_type = 'lead'").count() == len(got)


def test_lines_of_rulings(spark):
    lines = ["I. Facts", "A. x", "Title Case Of It", "Title Case.", "Not title case", "Don'T Ask", "Don't Ask", "", "É Été", "AB", "2 Rows", "ends 12 - 14", "12-14 no", "a 1-2 ", "x1-2"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("x", rulings.is_caption("x").alias("c"), rulings.is_page_range("x").alias("p")).collect()
    for r in got:
        s = r["x"].strip()
        assert r["p"] == bool(PAGES.search(s))
        assert r["c"] == (bool(s) and bool(re.match(r"^\s*([IVXLCDM]{1,8}|[A-Z])\.\s+(.*\S)\s*$", s) or (len(s) <= 80 and s == s.title() and not s.endswith(".")))), s


def test_incoming_by_id(spark):
    rows = spark.createDataFrame([(0, "k1", "Text", "q"), (0, "para-k2", "", "q" * 90), (0, " ", "Text", None), (0, None, None, None)], "doc_id int, para string, text string, quote string")
    got = [(r["para"], r["placed"], r["short"]) for r in notes.incoming_by_id(rows).collect()]
    assert got == [("para-k1", True, "Text"), ("para-k2", False, "q" * 70), ("", False, "Text"), ("", False, "")]
