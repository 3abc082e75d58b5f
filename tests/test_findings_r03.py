"""What the review of round 3 found slow: the same results without the steps that grew too fast."""

import random
from difflib import SequenceMatcher

import pytest

from pyspark.sql import functions as F

from quire import store
from quire.functions import similarity as sim
from quire.functions import text as t
from quire.operators import blocks, checks, layout, match, migrate
from quire.plans.queries import QUERIES
from quire.sources import source_text


def overlap(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x)


def texts(n, seed):
    r = random.Random(seed)
    made = []
    for _ in range(n):
        if made and r.random() < 0.6:
            words = r.choice(made).split()
            for _ in range(r.randrange(1, 9)):
                words[r.randrange(len(words))] = f"w{r.randrange(40)}"
            made.append(" ".join(words[r.randrange(3) :]))
        else:
            made.append(" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(4, 60))))
    return made


def test_scores_are_left_early_only_where_they_are_too_low():
    made = texts(60, 1)
    for a in made[::2]:
        for b in made[1::2]:
            full, asked = sim.scored(a, b)[0], sim.scored(a, b, 0.86)[0]
            assert asked == full if full >= 0.86 else asked < 0.86
            first = sim.longest_run(a, b)
            assert sim._matched(a, b, first) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_similar_texts_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(match, "BLOCK_WORDS", 100)
    monkeypatch.setattr(match, "overlapping", lambda *_: pytest.fail("pairs of texts by single words"))
    old, new = texts(30, 2), texts(40, 3) + [x + " and w1" for x in texts(30, 2)[::3]]
    rows = lambda made, name: spark.createDataFrame([(k % 2, k, f"{name}{k}", f"key{k}", x) for k, x in enumerate(made)] + [(None, 99, f"{name}99", "key99", made[0])], "doc_id long, ord long, id string, key string, text string")
    a = rows(old, "a").selectExpr("doc_id", "id AS old_id", "text AS norm")
    b = rows(new, "b").selectExpr("doc_id", "id", "text AS norm2")
    got = [tuple(r) for r in match.alike(a, b, "old_id", "id", 0.45, 0.6).collect()]
    want = {(i % 2, f"a{i}", f"b{j}") for i, x in enumerate(old) for j, y in enumerate(new) if i % 2 == j % 2 and overlap(x, y) >= 0.45 and 2 * min(len(x), len(y)) >= 0.6 * (len(x) + len(y))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) < 600
    how = {r["old_id"]: r["how"] for r in migrate.migrated(rows(old, "a"), rows(new, "b")).collect()}
    assert "similar" in how.values() or "contained" in how.values()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_made_once_for_all_checks(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def page(body):
        made.add(1)
        return body

    ids = spark.createDataFrame([(1, "para-a"), (1, "para-b"), (2, "para-c")], "doc_id long, id string")
    blocks = ids.withColumn("kind", F.lit("para"))
    html = '<div id="para-a"><div id="para-a"><button data-para="para-a">'
    pages = spark.createDataFrame([(1, html), (2, '<div id="para-c"><button data-para="para-c"><script src="notes.js"></html>')], "doc_id long, html string").select("doc_id", page("html").alias("html"))
    notes = spark.createDataFrame([(1, "para-z", " "), (2, "para-c", "x")], "doc_id long, para string, text string")
    got = {(r["doc_id"], r["name"]): (r["status"], r["detail"]) for r in checks.report(blocks, pages, notes).collect()}
    bad = {
        "paragraphs on the page": ("fail", "1, first para-b"), "ids unique": ("fail", "1, first para-a"), "notes have paragraphs": ("fail", "1, first para-z"), "paragraphs clickable": ("ok", ""),
        "notes have text": ("warn", "1, first para-z"), "page complete": ("fail", "1, first "), "notes file loaded": ("fail", "1, first "),
    }
    assert got == {(1, name): x for name, x in bad.items()} | {(2, name): ("ok", "") for name in bad} and made.value == 2


def test_lines_are_folded_once_and_the_dash_found_once(spark):
    docs = spark.createDataFrame([(1, "Article 1 of it\n(a) one\n(a) one"), (2, "TITLE: x\n---\n{k} (b) two\n---")], "doc_id long, text string")
    made = source_text.from_documents(docs)
    assert plan(made).count("_folded(") == 1
    assert plan(source_text.parse(docs)[2]).count("---") <= 2
    keys = [r["key"] for r in made.filter("doc_id = 1").orderBy("ord").collect()]
    assert keys[2] == f"{keys[1]}-2" and [(r["key"], r["text"]) for r in source_text.parse(docs)[2].filter("doc_id = 2").orderBy("ord").collect()] == [("k", "two"), ("2", "---")]


def test_furniture_is_dropped_without_joins_by_text(spark):
    lines = [(1, p, p * 3 + k, x, 100.0, y, 150.0, y + 10.0) for p in (1, 2, 3) for k, (x, y) in enumerate([("The Court", 20.0), (f"own line of {p}", 60.0), (f"and {'x' * p}", 78.0)])]
    rows = spark.createDataFrame([*lines, (2, 1, 0, "The Court", 100.0, 20.0, 150.0, 30.0)], "doc_id long, page int, idx int, text string, x0 double, y0 double, x1 double, y1 double")
    kept = layout.drop_furniture(rows, layout.furniture(rows, F.lit(842.0)), F.lit(842.0), F.lit(595.0))
    assert "_exact" not in plan(kept)
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(d, x) for d, _, _, x, *_ in lines if x != "The Court" and not x.startswith("own")} | {(2, "The Court")}


def test_a_large_file_is_read_by_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(100_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    monkeypatch.setattr(store, "TASK_BYTES", 20_000, raising=False)
    assert store.spread(spark.read.parquet(f"{tmp_path}/one")).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_words_of_materials_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Alpha of beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES["q_materials_rank"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1.0, 1)] and plan(found).count("array_except(") <= 2


def test_adjacent_pairs_are_found_by_digests(spark, monkeypatch):
    written, cut = {}, match.cut
    monkeypatch.setattr(match, "FEW_ROWS", 1)
    monkeypatch.setattr(match, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    lines = ["the court held that the state", "must comply with all its duties", "under the law of nations here", "and no other rule of any kind"]
    paras = spark.createDataFrame([(0, k, k, x) for k, x in enumerate(lines)], "doc_id long, id long, ord long, text string")
    quotes = spark.createDataFrame([(0, "a", f"{lines[0]} {lines[1]}"), (0, "b", f"{lines[1]} {lines[2]}"), (0, "c", f"{lines[2]} and no othr rule of any kind")], "doc_id long, quote_id string, quote string")
    got = {r["quote_id"]: (r["id"], r["score"] == 1.0) for r in match.across(quotes, paras).collect()}
    assert got == {"a": (0, True), "b": (1, True), "c": (2, False)} and "norm" not in written["across-known"].columns


ENDS = ["", "-", "--", " ", "\t", "\u00a0", "\u2028", "\u0085", ".", ";)", ":\u201d", "!'\"", ",", "?]", "\u2019", "x-", "a -", " - ", "\u201c"]


def test_lines_are_dealt_once_and_joined_with_no_page(spark):
    """Sizes, steps and boxes by windows: the lines of a document, with their texts, meet one join, with its compounds."""
    df = QUERIES["q_assemble_blocks"](spark, "/root/testdata/sf0.001")
    made = plan(df)
    assert made.count("Join") == 1 and made.count("joined_lines") == 0 and made.count("aggregate(lines") == 1
    rows = [(k % 3, 1 + k // 4, k % 2, k, x, 10.0 * (k % 5), 7.0 * k % 31, 50.0 + k % 7, [9.0, 10.04, 10.0, 12.0, None][k % 5], k % 4 == 0, 0.0) for k, x in enumerate(ENDS * 2)]
    rows += [(None, 1, 0, 0, "lost", 1.0, 1.0, 2.0, 10.0, False, 0.0), (4, None, 0, 0, "lost", 1.0, 1.0, 2.0, 10.0, False, 0.0), (5, 1, 0, 0, None, 1.0, 1.0, 2.0, None, None, 0.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, col int, idx int, text string, x0 double, y0 double, x1 double, size double, bold boolean, indent double")
    body = {r["doc_id"]: r["size"] for r in layout.body_size(lines).collect()}
    gap = {r["doc_id"]: r["gap"] for r in layout.modal(layout.gaps(lines, ["doc_id", "page", "col"]), ["doc_id"], "gap").collect()}
    got = blocks.boundaries(lines).collect()
    assert len(got) == len(rows) - 2
    assert {r["doc_id"]: (r["body"], r["spacing"]) for r in got} == {d: (body.get(d), gap.get(d)) for d in (0, 1, 2, 5)}


def test_ends_and_markers_of_odd_lines(spark):
    texts = [a + b + c for a in ("", "(1) ", "\u00a7 2. ", "\u2022 ", "x (1) ", "\n(a) ", "\u3000") for b in ("", "word", "caf\u00e9 \u201cx", "a\u2028b") for c in ENDS]
    s, plain = t.strip("text"), t.plain("text")
    made = spark.createDataFrame([(x,) for x in [*texts, None]], "text string").withColumns({"a": t.stripped("text"), "b": s})
    said = t.without_closers(F.col("a"))
    pairs = {
        "stripped": (F.col("a"), F.col("b")), "stops": (t.ends_in(said, ".;!?"), s.rlike(t.SENTENCE_STOP)), "ends": (t.ends_in(said, ".;:!?"), s.rlike(t.SENTENCE_END)), "pauses": (t.ends_in(said, ".,;:!?"), s.rlike(t.ANY_END)),
        "marked": (t.has_marker("text"), plain.rlike("|".join(f"(?:{p})" for p, *_ in t.MARKERS))), "quotes": (t.quote_balance("text"), F.length(F.translate(plain, t.CLOSING, "")) - F.length(F.translate(plain, t.OPENING, ""))),
    }
    off = made.select("text", *[(~x.eqNullSafe(y)).alias(k) for k, (x, y) in pairs.items()]).filter(" or ".join(pairs))
    assert [r.asDict() for r in off.collect()] == []


def test_lines_are_joined_as_by_a_fold(spark):
    rng = random.Random(5)
    bits = [*ENDS, "word", "co-", "operation", "Self-", "  padded  ", "Upper", "a-b", None]
    rows = [([rng.choice(bits) for _ in range(rng.randrange(1, 6))],) for _ in range(1500)] + [([x],) for x in bits] + [([],)]
    known = F.array(F.lit("co-operation"))
    fold = F.aggregate("lines", F.lit(""), lambda text, line: t.join_lines(text, line, known))
    off = spark.createDataFrame(rows, "lines array<string>").select("lines", t.joined_lines(F.col("lines"), known).alias("got"), fold.alias("want")).filter("not (got <=> want)")
    assert [r.asDict() for r in off.collect()] == []


def test_split_recitals_are_numbered_without_gaps(spark):
    long = "Whereas " + "words " * 20 + "here, Recalling the text, Noting it; Desiring more"
    rows = [(1, 2, "heading", "Title", "", 2), (1, 5, "para", long, "\u00b6", 0), (1, 9, "para", "short", "(a)", 0), (2, 1, "para", "one", "\u00b6", 0)]
    got = blocks.split_recitals(spark.createDataFrame(rows, "doc_id long, ord int, kind string, text string, label string, level int")).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["ord"]) for r in got] == [(1, k) for k in range(1, 7)] + [(2, 1)] and got[2]["text"] == "Recalling the text,"
