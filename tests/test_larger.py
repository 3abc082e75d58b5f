"""What showed only on larger tables: cut references, ids instead of texts, headings that equal their quote, lines of many pages in one batch."""

import random

import numpy as np
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import layout, match, notes
from quire.sources import web


def test_a_reference_cut_off_in_a_title_stays(spark):
    rows = spark.createDataFrame([(1, "<title>a &amp; b&#33; c &amp</title>"), (2, "<title>&lt;b&gt &ampx</title>")], "i int, html string")
    assert [r["t"] for r in rows.select("i", web.title("html", closed=True).alias("t")).sort("i").collect()] == ["a & b! c &amp", "<b&gt &ampx"]
    assert rows.select(web.title("html").alias("t")).first()["t"] == "a & b! c &"


def _says_the_same(a: str, b: str) -> bool:
    low, high = sorted((a, b), key=len)
    need = -(-9 * len(high) // 10)
    return len(low) >= max(60, need) and any(low[i : i + need] in high for i in range(len(low) - need + 1))


def test_alike_finds_all_pairs_by_pieces(spark):
    draw = random.Random(3)
    texts = set()
    for _ in range(40):
        base = " ".join("".join(draw.choices("abcde", k=draw.randint(1, 9))) for _ in range(draw.randint(9, 60)))
        for _ in range(6):
            n = len(base)
            low, high = draw.randint(0, n // 8), n - draw.randint(0, n // 8)
            texts.add(("x " * draw.randint(0, 4) + base[low:high] + " y" * draw.randint(0, 4)).strip())
    texts = sorted(texts | {"again and " * 30 + "again", "again and " * 31 + "again", "a" * 60, "a" * 66})
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "doc_id int, id int, norm string")
    got = {(r["id"], r["id2"]) for r in notes.alike(rows).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and _says_the_same(a, b)}
    assert got == want and len(want) > 100


def test_a_quote_that_equals_the_first_heading_is_compared_with_no_other(spark, monkeypatch):
    blocks = spark.createDataFrame([(1, 0, "h", "heading", "On the Sea"), (1, 1, "p", "para", "x"), (1, 2, "g", "heading", "On the Sea and the Land"), (1, 3, "q", "para", "y"), (2, 0, "h", "heading", "Of the Land and all"), (2, 1, "p", "para", "x"), (2, 2, "g", "heading", "The Land"), (2, 3, "q", "para", "y")], "doc_id int, ord int, id string, kind string, text string")
    quotes = spark.createDataFrame([(1, "a", "ON THE SEA"), (2, "b", "the land")], "doc_id int, quote_id string, quote string")
    assert {(r["quote_id"], r["id"]) for r in match.after_heading(quotes, blocks).collect()} == {("a", "p"), ("b", "p")}  # the second is held by an earlier heading
    monkeypatch.setattr(match, "_headed", None)
    assert [r["id"] for r in match.after_heading(quotes.filter("doc_id = 1"), blocks).collect()] == ["p"]


def test_folding_needs_no_pattern_in_the_jvm(spark):
    rows = spark.createDataFrame([("Œuvre “of  di\"erent” ﬁnds,K İx — A1",), (None,)], "x string").select(t.folded("x").alias("n"), t.repaired("x").alias("r"))
    assert [r["n"] for r in rows.collect()] == ["oeuvre of diffferent finds k i x a1".replace("fff", "ff"), ""]
    assert "regexp_replace" not in rows._jdf.queryExecution().executedPlan().toString().lower()
    assert [r["k"] for r in spark.createDataFrame([("12 ab 3c d4 5",), ("1 2 ab 3 c",)], "x string").select(t.furniture_keys("x")["counted"].alias("k")).collect()] == ["# ab 3c d4 #", None]
    assert rows.select(F.length("n")).first()[0] > 0


def test_columns_of_many_pages_over_small_batches(spark):
    draw = random.Random(5)
    rows = [(d if d else None, p, i, *((60.0, 60.0 + draw.randint(50, 220)) if i % 2 else (310.0, 310.0 + draw.randint(50, 220)))) for d in range(4) for p in range(3) for i in range(draw.choice([1, 3, 8, 30]))]
    frame = spark.createDataFrame(rows, "doc_id int, page int, idx int, x0 double, x1 double")
    want = {}
    for d, p in {(r[0], r[1]) for r in rows}:
        page = [r for r in rows if r[:2] == (d, p)]
        bands = layout.column_bands(np.array([r[3] for r in page]), np.array([r[4] for r in page]), 595.0)
        want |= {r[:3]: next(k for k, (a, b) in enumerate(bands) if a <= r[3] < b) for r in page}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = layout.columns(frame, 595.0)
        assert {(r["doc_id"], r["page"], r["idx"]): r["col"] for r in found.collect()} == want and 1 in want.values()
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
