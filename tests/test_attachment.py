"""What becomes of notes, against the notes taken one by one."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import attachment, notes

SCHEMA = "doc_id int, ord int, target string, origin string, author string, text string, clash string"
SENTENCE = "The committee considered this provision at length in its second session and adopted it without a vote of any kind"


def folded(spark, texts):
    return {r["x"]: r["n"] for r in spark.createDataFrame([(x,) for x in set(texts)], "x string").select("x", t.folded("x").alias("n")).collect()}


def said_same(a, b):
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    return len(short) >= 60 and SequenceMatcher(None, short, long, autojunk=False).find_longest_match(0, len(short), 0, len(long)).size >= 0.9 * len(long)


def one_by_one(rows, norm, by_origin):
    out, kept, keys = {}, {}, set()
    for doc, at, target, origin, author, text, _ in sorted(rows, key=lambda r: r[:2]):
        n, earlier = norm[text] if text is not None else "", kept.setdefault(doc, [])
        if target is None:
            out[doc, at] = "absorbed" if n and any(said_same(n, e) for e, _ in earlier) else "unplaced"
            continue
        key = (doc, target, author or "", text or "")
        if key in keys or (len(n) > 40 and any(said_same(n, e) for e, o in earlier if not by_origin or o != origin)):
            out[doc, at] = "duplicate"
            continue
        keys.add(key)
        earlier.append((n, origin))
        out[doc, at] = "attached"
    return out


def made(n, seed):
    """Sentences that differ at their ends by ever more, so that each says the same as its neighbours in a chain only; short ones, copies, nulls."""
    rng, rows = random.Random(seed), []
    words = SENTENCE.split()
    for i in range(n):
        k = rng.randrange(8)
        text = " ".join([*words[k % 4 :], *(f"x{j}" for j in range(k))])
        text = rng.choice([text, text, text.upper() + "!", SENTENCE, "Short note.", f"Note {rng.randrange(3)}", "", None, "word " * 30 + str(k), f"{SENTENCE} {rng.randrange(4)} and {SENTENCE}"])
        rows.append((rng.randrange(2), i, rng.choice(["a", "b", "c", None]), rng.choice(["file", "page"]), rng.choice(["A", None]), text, "x"))
    return rows


@pytest.mark.parametrize("by_origin, seed", [(False, 1), (True, 2), (False, 3)])
def test_settled(spark, by_origin, seed):
    rows = made(120, seed)
    found = attachment.settled(spark.createDataFrame(rows, SCHEMA).repartition(3), by_origin)
    assert found.columns == [*spark.createDataFrame([], SCHEMA).columns, "outcome"]
    want = one_by_one(rows, folded(spark, [r[5] for r in rows if r[5] is not None]), by_origin)
    assert {(r["doc_id"], r["ord"]): r["outcome"] for r in found.collect()} == want and len(set(want.values())) == 4


def test_settled_without_rows(spark):
    assert attachment.settled(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_chain_alternates(spark):
    nodes = spark.createDataFrame([(str(i), i) for i in range(9)], "node string, at int")
    links = spark.createDataFrame([(str(i), str(j)) for i in range(9) for j in (i - 1, i + 1) if 0 <= j < 9], "node string, other string")
    assert sorted(r["node"] for r in attachment.first_independent(nodes, links).collect()) == ["0", "2", "4", "6", "8"]


def test_same_run_is_the_matchers(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(50, 80))) for _ in range(30)]
    pairs = [(a, b) for a in texts for b in (a[: len(a) - rng.randrange(9)], "b" * rng.randrange(8) + a, a[3:] + "aa", rng.choice(texts))]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", notes.same_run(F.col("a"), F.col("b")).alias("same")).collect()
    for r in rows:
        short, long = sorted((r["a"], r["b"]), key=len)
        run = SequenceMatcher(None, short, long, autojunk=False).find_longest_match(0, len(short), 0, len(long)).size
        assert r["same"] == (len(short) >= 60 and 10 * run >= 9 * len(long))
    assert 20 < sum(r["same"] for r in rows) < 100
