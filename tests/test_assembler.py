"""The assembler of lines against a fold of each whole document, line by line."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import blocks, layout
from quire.plans import tables


def begins(prev, cur, after_marker):
    if prev is None or prev.col != cur.col:
        return True
    if prev.page != cur.page:
        return bool(prev.ends)
    if abs(cur.size - prev.size) > max(0.6, 0.08 * cur.body) or (cur.bold and not prev.bold and cur.size >= cur.body):
        return True
    if cur.opens and not prev.stops:
        return False
    if cur.spacing and cur.y0 - prev.y0 > 1.4 * cur.spacing > 0 and prev.stops:
        return True
    step = cur.indent - prev.indent
    if not after_marker and step > 2:
        return bool(prev.pauses if step <= max(24.0, 3 * cur.body) else prev.stops)
    return bool(prev.lists and cur.recital)


def line_by_line(rows):
    """[kind, label, level, lines] of each block."""
    out, held, label, prev, after_marker, quotes = [], None, "", None, False, 0
    for row in rows:
        if row.bare:
            held, label, quotes = None, row.mark["label"], 0
        else:
            quoted = held is not None and quotes > 0 and sum(map(len, held[3])) < blocks.QUOTE_LIMIT
            if not (label or held is None or held[0] == "heading" or (not quoted and (row.marked or row.structural or begins(prev, row, after_marker)))):
                held[3].append(row.text)
                quotes += row.quotes
            elif not label and row.level:
                held, quotes = ["heading", "", row.level, [row.text.strip()]], 0
                out.append(held)
            else:
                held, quotes = ["para", label or row.mark["label"], 0, [row.mark["rest"] if row.marked else row.text]], row.quotes
                out.append(held)
            label = ""
        after_marker, prev = row.bare or row.marked, row
    return out


def stretches(spark, lines, monkeypatch):
    """What assembled() folds, before lines are joined and keys made."""
    seen = []
    monkeypatch.setattr(blocks.layout, "compounds", lambda x: x.select("doc_id").distinct().withColumn("compounds", F.lit(None).cast("array<string>")))
    monkeypatch.setattr(blocks.t, "joined_lines", lambda x, *_: F.to_json(x))
    monkeypatch.setattr(blocks, "split_recitals", lambda x: seen.append(x) or x)
    blocks.assembled(lines)
    return {(r["doc_id"], r["ord"]): (r["kind"], r["label"], r["level"], r["text"]) for r in seen[0].collect()}


def check(spark, lines, monkeypatch):
    by_doc = {}
    for r in blocks.boundaries(lines).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    as_json = {tuple(r["lines"]): r["j"] for r in spark.createDataFrame([(b[3],) for rows in by_doc.values() for b in line_by_line(sorted(rows, key=lambda r: (r.page, r.col, r.idx)))], "lines array<string>").select("lines", F.to_json("lines").alias("j")).collect()}
    want = {}
    for doc, rows in by_doc.items():
        for k, (kind, label, level, parts) in enumerate(line_by_line(sorted(rows, key=lambda r: (r.page, r.col, r.idx))), 1):
            if kind == "heading" or any(c.isalnum() for part in parts for c in part):
                want[doc, k] = (kind, label, level, as_json[tuple(parts)])
    got = stretches(spark, lines, monkeypatch)
    assert got == want
    return want


def test_whole_table(spark, monkeypatch):
    lines = layout.indents(tables.positioned(spark, "/root/testdata/sf0.001"), ["doc_id", "col"])
    assert len(check(spark, lines, monkeypatch)) > 1000


@pytest.mark.parametrize("seed, limit", [(1, 8000), (2, 60)])
def test_made_lines(spark, monkeypatch, seed, limit):
    """Bare markers, headings in a row, quotations that stay open, long and short ones, changes of page, column, size and indent."""
    monkeypatch.setattr(blocks, "QUOTE_LIMIT", limit)
    rng = random.Random(seed)
    texts = ["Article 5", "PART II", "(a)", "§", "(1) the first item;", "held that: “the state", "shall comply.”", "“Nothing here", "plain words go on", "and end.", "Recalling the text,", "Noting also;", "TITLE IN CAPITALS", "1.", "•", "...", "x ” y", "word " * 12, "  padded  ", "ends here: ”"]
    rows = []
    for doc in range(12):
        for i in range(rng.randrange(1, 70)):
            text, size = rng.choice(texts), rng.choice([10.0, 10.0, 10.0, 12.0])
            x0 = 100.0 + rng.choice([0, 0, 0, 12, 40])
            rows.append((doc, 1 + i // 20, i, i // 9 % 2, text, x0, 60.0 + 18.0 * (i % 20) + rng.choice([0, 0, 14]), x0 + 5.0 * len(text), 70.0 + 18 * (i % 20), size, rng.random() < 0.1, x0 - 100.0))
    lines = spark.createDataFrame(rows, "doc_id int, page int, idx int, col int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, indent double")
    assert {x[0] for x in check(spark, lines, monkeypatch).values()} == {"heading", "para"} and t
