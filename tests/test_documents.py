"""Layout, blocks, matching, notes and files on small tables."""

import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from quire.functions import spans
from quire.operators import blocks, layout, match, migrate, notes
from quire.sources import annotation_files, snapshots, source_text, web, word_files
from quire.streaming import folders

LINE = "doc_id string, page int, idx int, col int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, indent double"


def lines(spark, *rows):
    made = []
    for i, row in enumerate(rows):
        row = {"text": row} if isinstance(row, str) else row
        size, x0, y0 = row.get("size", 10.0), row.get("x0", 100.0), row.get("y0", 20.0 + 14 * i)
        made.append(("d", row.get("page", 1), i, 0, row["text"], x0, y0, x0 + max(20.0, len(row["text"]) * size * 0.5), y0 + size, size, row.get("bold", False), row.get("indent", 0.0)))
    return spark.createDataFrame(made, LINE)


def texts(df):
    return [(r["kind"], r["label"], r["text"]) for r in df.orderBy("ord").collect()]


def test_assembler(spark):
    found = blocks.assembled(lines(
        spark, {"text": "ARTICLE 1", "size": 12.0}, "The parties shall coop-", "erate in good", "faith.", "(a)", "first clause", "(b) second clause", {"text": "A new page goes", "page": 2, "y0": 20.0}, {"text": "on here.", "page": 2, "y0": 34.0},
    ))
    assert texts(found) == [("heading", "", "ARTICLE 1"), ("para", "¶", "The parties shall cooperate in good faith."), ("para", "(a)", "first clause"), ("para", "(b)", "second clause A new page goes on here.")]
    assert {r["section"] for r in found.collect()} == {"ARTICLE 1"}


def test_quotation_stays_together(spark):
    found = blocks.assembled(lines(spark, "The court held: “First,", "(1) the state", "(2) shall comply.”", "(3) Next."))
    assert texts(found) == [("para", "¶", "The court held: “First, (1) the state (2) shall comply.”"), ("para", "(3)", "Next.")]


def test_word_assembler(spark):
    rows = [("d", i, *x) for i, x in enumerate([("Part I", 1), ("The text goes", 0), ("on in lower case", 0), ("Finished.", 0), ("Another one", 0), ("1. Clause", 0), ("", 0)])]
    found = blocks.assembled_word(spark.createDataFrame(rows, "doc_id string, ord int, text string, level int"))
    assert texts(found) == [("heading", "", "Part I"), ("para", "¶", "The text goes on in lower case Finished."), ("para", "¶", "Another one"), ("para", "1.", "Clause")]


def test_keys_of_repeats(spark):
    rows = spark.createDataFrame([("d", i, "para", x) for i, x in enumerate(["Same text", "same  TEXT!", "Other", "Same text"])], "doc_id string, ord int, kind string, text string")
    keys = [r["key"] for r in blocks.keyed(rows).orderBy("ord").collect()]
    assert keys[1] == keys[0] + "-2" and keys[3] == keys[0] + "-3" and "-" not in keys[2]


def test_layout(spark):
    rows = lines(spark, *[{"text": x, "page": p, "y0": y} for p in (1, 2, 3) for x, y in ((f"Report of the Court {p}", 10.0), ("Body text of a page", 300.0), (f"Body again {p}", 320.0), (str(p), 830.0))])
    found = layout.furniture(rows, F.lit(842.0))
    assert {(r["band"], r["key"]) for r in found.collect()} == {("header", "report of the court #")}
    kept = [r["text"] for r in layout.drop_furniture(rows, found, F.lit(842.0), F.lit(595.0)).orderBy("idx").collect()]
    assert kept == [x for p in (1, 2, 3) for x in ("Body text of a page", f"Body again {p}")]
    assert layout.body_size(rows).first()["size"] == 10.0


def test_columns(spark):
    two = lines(spark, *[{"text": "some words in a column of text", "x0": x, "y0": 30.0 + 12 * i} for i in range(10) for x in (60.0, 320.0)])
    found = {(r["x0"], r["col"]) for r in layout.columns(two, 595.0).join(two.select("idx", "x0").withColumnRenamed("x0", "_"), "idx").select("x0", "col").collect()}
    assert found == {(60.0, 0), (320.0, 1)}


def test_body_start_and_runs(spark):
    text = "word " * 40
    rows = lines(spark, "Contents", "A 1", *[f"{i}. {text}" for i in range(1, 8)], "x", "y", "z", "q", "r", "s", "t", "u")
    assert layout.body_start(rows).first()["start"] == 3
    listed = lines(spark, *[f"Title {i} ..... {i}" for i in range(6)], "Body starts here", "and", "goes", "on")
    first = layout.front_matter(listed).first()
    assert (first["kind"], first["start"], first["length"]) == ("contents", 1, 6)


def paras(spark, *rows):
    return spark.createDataFrame([(0, i, f"p{i}", x) for i, x in enumerate(rows)], "doc_id int, ord int, id string, text string")


def ask(spark, *rows):
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(rows)], "doc_id int, quote_id int, quote string")


def test_matching(spark):
    there = paras(
        spark, "The seller must deliver the goods, hand over any documents relating to them and transfer the property.", "The buyer must pay the price for the goods and take delivery of them.",
        "This Convention governs only the formation of the contract of sale.", "This Convention governs only the formation of the contract of sale.", "Short.",
    )
    asked = ask(
        spark, "hand over any DOCUMENTS relating", "The buyer must pay the prise for the goods and take delivery of them", "governs only the formation", "nothing of the kind is said anywhere here",
        "Before. The buyer must pay the price for the goods and take delivery of them. And more after that.", "",
    )
    found = {r["quote_id"]: (r["status"], r["id"]) for r in match.matched(asked, there).collect()}
    assert found == {0: ("ok", "p0"), 1: ("ok", "p1"), 2: ("ambiguous", None), 3: ("no_match", None), 4: ("ok", "p1"), 5: ("no_match", None)}
    near = match.nearest_runner(match.matched(asked, there), spark.createDataFrame([(0, 2, 0.8)], "doc_id int, quote_id int, position double"), there)
    assert near.first()["id"] == "p3"


def test_across_and_heading(spark):
    there = paras(spark, "The first sentence ends here with words.", "The second sentence begins and goes on.", "Unrelated paragraph text.")
    over = match.across(ask(spark, "sentence ends here with words. The second sentence begins"), there)
    assert over.first()["id"] == "p0"
    heads = there.withColumn("kind", F.when(F.col("ord") == 0, "heading").otherwise("para"))
    assert match.after_heading(ask(spark, "The first sentence ends here with words"), heads).first()["id"] == "p1"


def test_attached(spark):
    there = paras(spark, "The seller must deliver the goods to the buyer.", "The buyer must pay the price for the goods.").withColumns({"kind": F.lit("para"), "id": F.concat(F.lit("para-"), "id")})
    alias = spark.createDataFrame([(0, "para-9", "p1")], "doc_id int, old_id string, key string")
    rows = [(0, 1, "p0", "", "n"), (0, 2, "9", "", "n"), (0, 3, "zz", "", "n"), (0, 4, "", "pay the price", "n"), (0, 5, "", "about something else", "n")]
    found = match.attached(spark.createDataFrame(rows, "doc_id int, quote_id int, para string, quote string, text string"), there, alias)
    assert {r["quote_id"]: r["target"] for r in found.collect()} == {1: "para-p0", 2: "para-p1", 3: None, 4: "para-p1", 5: None}


def test_migration(spark):
    old = paras(spark, "Exact text stays here.", "Part of a longer text", "Wholly gone words", "Changed sligthly but still the same clause of the text.")
    new = paras(spark, "exact TEXT stays here", "Now part of a longer text than before", "Changed slightly but still the same clause of the text.").withColumns({"key": F.col("id"), "id": F.concat(F.lit("n"), "id")})
    assert {r["old_id"]: (r["key"], r["how"]) for r in migrate.migrated(old, new).collect()} == {"p0": ("p0", "exact"), "p1": ("p1", "contained"), "p2": ("p1", "neighbour"), "p3": ("p2", "similar")}
    assert {r["old_id"]: r["key"] for r in migrate.carried(old, new).collect()} == {"p0": "p0"}


NOTE = "doc_id int, para string, idx int, author string, title string, text string, source string"


def test_merge(spark):
    long = "This provision was discussed at length by the committee in its second session of that year, and adopted."
    store = spark.createDataFrame([(0, "a", 0, "A", "", "One note.", ""), (0, "a", 1, "B", "", long, "")], NOTE)
    incoming = spark.createDataFrame([(0, "a", 0, "A", "", "one NOTE", ""), (0, "a", 1, "B", "", long.replace("second session", "third meeting").replace("adopted", "then rejected outright"), ""), (0, "b", 0, "C", "", "New one", ""), (0, "b", 1, "C", "", "new one!", "")], NOTE)
    plan = notes.merge_plan(store, incoming)
    assert {(r["para"], r["idx"]): r["kind"] for r in plan.collect()} == {("a", 0): "duplicate", ("a", 1): "conflict", ("b", 0): "new", ("b", 1): "repeated"}
    state = lambda df: [(r["para"], r["idx"], r["text"][-8:]) for r in df.orderBy("para", "idx").collect()]
    assert state(notes.merge_apply(store, plan)) == [("a", 0, "ne note."), ("a", 1, "adopted."), ("b", 0, "New one")]
    take = spark.createDataFrame([(0, "a", 1, "take")], "doc_id int, para string, idx int, choice string")
    assert state(notes.merge_apply(store, plan, take))[1] == ("a", 1, "utright.")
    both = take.withColumn("choice", F.lit("both"))
    assert len(state(notes.merge_apply(store, plan, both))) == 4


def test_edits_and_versions(spark):
    store = spark.createDataFrame([(0, "a", i, "A", "", x, "") for i, x in enumerate("xyz")], NOTE)
    order = lambda df, para="a": "".join(r["text"] for r in df.filter(F.col("para") == para).orderBy("idx").collect())
    assert order(notes.moved(store, 0, "a", 0, 1)) == "yxz" and order(notes.moved(store, 0, "a", 2, -5)) == "zxy"
    assert order(notes.duplicated(store, 0, "a", 1)) == "xyyz"
    assert order(notes.updated(store, 0, "a", 1, text="Q")) == "xQz"
    assert order(notes.deleted(store, store.filter("text = 'y'").select("doc_id", "para", "idx"))) == "xz"
    gone = notes.moved_to(store, 0, "a", 0, "b")
    assert order(gone) == "yz" and order(gone, "b") == "x"
    more = spark.createDataFrame([(0, "a", "A", "", " w ", ""), (0, "a", "A", "", "  ", "")], "doc_id int, para string, author string, title string, text string, source string")
    assert order(notes.added(store, more, 1)) == "xwyz"
    held = notes.Versions(store)
    held.push(gone)
    assert order(held.undo()) == "xyz" and order(held.redo()) == "yz" and order(held.redo()) == "yz"


def test_source_round_trip(spark):
    text = "TITLE: A treaty\r\nIDMAP para-1=kab\n---\n\n## Article 1\n{kab} ¶ First text.\n(a) second text\nthird\n"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    meta, aliases, found = source_text.parse(docs)
    assert [(r["kind"], r["label"], r["text"], r["id"][:9]) for r in found.orderBy("ord").collect()][1:] == [("para", "¶", "First text.", "para-kab"), ("para", "(a)", "second text", "para-2"), ("para", "¶", "third", "para-3")]
    again = source_text.render(found, meta, aliases)
    parsed = source_text.parse(again)
    assert parsed[2].select("ord", "kind", "label", "text", "id").collect() == found.select("ord", "kind", "label", "text", "id").collect()
    assert parsed[0].collect() == meta.collect() and parsed[1].collect() == aliases.collect()
    bad = spark.createDataFrame([("x", "TITLE: t\nbody"), ("y", "---\n{k} a\n{k} b"), ("z", "---\n## only")], "doc_id string, text string")
    assert {(r["doc_id"], r["error"][:12]) for r in source_text.errors(bad).collect()} == {("x", "front matter"), ("y", "id given twi"), ("z", "no paragraph")}


def test_annotation_files(spark):
    files = [
        ("t", "n.txt", '@para-1\nAuthor: A\nTitle: T\nText of\nthe note\n\n"""\nsome quote\n"""\nPage: 3\n​Author: is part of it\n'), ("j", "n.json", '[{"id": "p", "comment_text": "x", "page": 4, "odd": "1"}, {"quote": "q", "note": "y"}, {"para": "p"}]'),
        ("m", "n.json", '{"p1": [{"author": "A", "text": "one"}, {"text": "two"}], "p2": [{"text": "three"}]}'), ("c", "n.csv", 'ID,Comment_Text,Quote\np,"a ""b"", c",\nr,text,some quote\n'),
        ("s", "n.js", 'window.NOTES = {"p": [{"text": "a {brace}"}]};\naddNote("q", "Me", "b \\"quoted\\"", "T", "S");'),
    ]
    found = annotation_files.loaded(spark.createDataFrame(files, "doc_id string, name string, text string"))
    rows = {(r["doc_id"], r["para"], r["quote"], r["author"], r["text"], r["page"]) for r in found.collect()}
    assert rows == {
        ("t", "para-1", "", "A", "Text of the note", 0), ("t", "", "some quote", "", "Author: is part of it", 3), ("j", "p", "", "", "x", 4), ("j", "", "q", "", "y", 0), ("m", "p1", "", "A", "one", 0), ("m", "p1", "", "", "two", 0),
        ("m", "p2", "", "", "three", 0), ("c", "p", "", "", 'a "b", c', 0), ("c", "", "some quote", "", "text", 0), ("s", "p", "", "", "a {brace}", 0), ("s", "q", "", "Me", 'b "quoted"', 0),
    }


def test_word_file(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:br/><w:t>b</w:t></w:r></w:p><w:p><w:commentRangeStart w:id="7"/><w:r><w:t>anchored</w:t></w:r><w:commentRangeEnd w:id="7"/></w:p></w:body></w:document>'
    notes_xml = f'<w:comments {w}><w:comment w:id="7" w:author="A" w:date="d"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:comment></w:comments>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/comments.xml", notes_xml)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no package")
    files = word_files.read(spark, str(tmp_path))
    assert [(r["text"], r["level"]) for r in word_files.paragraphs(files).orderBy("ord").collect()] == [("Part", 1), ("a", 0), ("b", 0), ("anchored", 0)]
    r = word_files.comments(files).first()
    assert (r["author"], r["text"], r["quote"], r["position"]) == ("A", "note", "anchored", 1.0)


def test_pages(spark):
    made = spark.createDataFrame([("d", 1, "heading", "H & h", "", 1, "para-h"), ("d", 2, "para", "a < b", "(1)", 0, "para-k")], "doc_id string, ord int, kind string, text string, label string, level int, id string")
    js = annotation_files.render_notes_js(spark.createDataFrame([("d", "para-k", 2, 0, "A", "", "note", "")], "doc_id string, para string, para_ord int, idx int, author string, title string, text string, source string"))
    page = web.rendered_pages(made, js)
    assert web.identified(page).select("id", "text").collect() == [("para-k", "a < b")]
    assert page.select(web.headings("html")).first()[0] == ["H & h"]
    assert page.select(web.notes_file("html")).first()[0] == "notes.js"
    script = spark.createDataFrame([("d", "x = [{title: 'T\\'s', subtitle: 'S', desc: 'D', href: 'h.html'}, {title: 'U', subtitle: '', desc: '', href: 'i'}]")], "doc_id string, html string")
    assert [r["href"] for r in web.cards(script).orderBy("ord").collect()] == ["h.html", "i"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb\na"), (2, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    run = folders.keyed_paragraphs(folders.documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", once=True)
    run.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_near_repeats(spark):
    long = "This provision was discussed at length by the committee in its second session of that year, and then adopted."
    rows = [(0, "a", 0, "A", "", long, "", 1), (0, "b", 0, "B", "", "Also: " + long, "", 2), (0, "c", 0, "C", "", "Quite another note on the same provision of the committee.", "", 3), (1, "d", 0, "A", "", long, "", 4), (0, "e", 0, "A", "", "Short.", "", 5), (0, "f", 0, "A", "", "Short.", "", 6)]
    kept = notes.without_near_repeats(spark.createDataFrame(rows, NOTE + ", ord int"), "ord")
    assert sorted(r["para"] for r in kept.collect()) == ["a", "c", "d", "e", "f"]


def test_compounds(spark):
    rows = lines(spark, "The self-determination of peoples and a well-known-fact end-", "self-", "x-ray co-operation, of Self-Determination.")
    assert layout.compounds(rows).first()["compounds"] == ["co-operation", "self-determination"]


def brute_furniture(rows, height, width):
    """Isolated first and last lines and page numbers, in plain Python: what stays of rows (page, idx, text, x0, y0, x1, y1)."""
    pages = {}
    for r in rows:
        pages.setdefault(r[0], []).append(r)
    steps = {}
    for page in pages.values():
        for a, b in zip(page, page[1:]):
            if 0 < b[4] - a[4] < 200:
                steps[round(b[4] - a[4])] = steps.get(round(b[4] - a[4]), 0) + 1
    usual = max(steps, key=lambda k: steps[k])
    kept = []
    for number, page in sorted(pages.items()):
        gone = {i for i, r in enumerate(page) if r[2].isdigit() and (r[4] <= 0.22 * height or r[6] >= 0.82 * height)}
        if len(page) >= 3:
            first, second, last, before = page[0], page[1], page[-1], page[-2]
            if number != min(pages) and first[4] <= 0.22 * height and first[5] - first[3] <= 0.7 * width and second[4] - first[6] > 1.6 * usual:
                gone.add(0)
            if last[6] >= 0.82 * height and last[5] - last[3] <= 0.7 * width and last[4] - before[6] > 1.6 * usual:
                gone.add(len(page) - 1)
        kept += [r[2] for i, r in enumerate(page) if i not in gone]
    return kept


def test_isolated_lines(spark):
    made = []
    for page in range(1, 7):
        top = 40.0
        for i in range(30):
            step = {0: (12.0, 20.0, 29.0, 32.0, 40.0, 12.0)[page - 1], 28: (12.0, 30.0, 20.0, 27.0, 29.5, 60.0)[page - 1]}.get(i, 12.0)
            wide = 450.0 if page == 6 and i == 29 else 300.0
            made.append((page, len(made), f"line {'abcdefghij'[i % 10]}{'klmnop'[page - 1]} {'of the page' if i % 7 else 'at some place'}" if not (page == 2 and i == 29) else "17", 60.0, top, 60.0 + wide, top + 10.0))
            top += step if i != 26 else 400.0
    rows = spark.createDataFrame([("d", p, i, x, a, b, c, e, 10.0, False) for p, i, x, a, b, c, e in made], "doc_id string, page int, idx int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean")
    none = layout.furniture(rows, F.lit(842.0)).filter("false")
    kept = [r["text"] for r in layout.drop_furniture(rows, none, F.lit(842.0), F.lit(595.0)).orderBy("idx").collect()]
    want = brute_furniture(made, 842.0, 595.0)
    assert kept == want and len(want) < len(made)


def test_json_notes(spark):
    files = [("a", '[{"match": "q", "target": "p1", "heading": "T", "text": "x", "comment_text": "y", "kind": "k", "page": "3"}]'), ("b", '{"para-1": [{"note": "n", "by": "B"}], "para-2": []}'), ("c", "[1, 2]"), ("d", '{"x": 3}'), ("e", "{broken"), ("f", "7"), ("g", '[{"note": ""}]')]
    docs = spark.createDataFrame(files, "doc_id string, text string")
    found = {r["doc_id"]: r for r in annotation_files.from_json(docs).collect()}
    assert (found["a"]["para"], found["a"]["quote"], found["a"]["title"], found["a"]["text"], found["a"]["page"]) == ("p1", "q", "T", "x", 3) and found["a"]["meta"] == {"kind": "k"}
    assert (found["b"]["para"], found["b"]["author"], found["b"]["text"]) == ("para-1", "B", "n") and set(found) == {"a", "b"}
    assert {r["doc_id"]: r["error"] for r in annotation_files.json_errors(docs).collect()} == {"c": "a note is not an object", "d": "not a map of paragraph ids to notes", "e": "not valid JSON", "f": "neither a list of notes nor a map of paragraph ids"}


def test_notes_js_format(spark):
    rows = [("d", "para-b", 2, 0, "A", "", 'say "x"', ""), ("d", "para-a", 1, 1, "", "T", "two", ""), ("d", "para-a", 1, 0, "B", "", "one", "S")]
    js = annotation_files.render_notes_js(spark.createDataFrame(rows, "doc_id string, para string, para_ord int, idx int, author string, title string, text string, source string")).first()["text"]
    head, tail = js.split(";\n", 1)
    want = {"para-a": [{"author": "B", "text": "one", "source": "S"}, {"title": "T", "text": "two"}], "para-b": [{"author": "A", "text": 'say "x"'}]}
    assert head == "window.NOTES = " + json.dumps(want, ensure_ascii=False, indent=2) and tail == "window.dispatchEvent(new Event('notes:ready'));\n"


def test_store_of_notes(spark):
    kinds = "doc_id string, para string, para_ord int, idx int, author string, title string, text string, source string"
    store = spark.createDataFrame([("d", "p", 1, 0, "A", "", "a stored note", "")], kinds)
    more = spark.createDataFrame([("d", "p", 1, 0, "A", "", "A stored NOTE", ""), ("d", "p", 1, 1, "A", "", "another", ""), ("d", "p", 1, 2, "A", "", " ", ""), ("d", "p", 1, 3, "A", "", "another", "")], kinds)
    assert sorted(r["text"] for r in notes.merge_entries(store, more).collect()) == ["a stored note", "another"]
    reason = spark.range(1).select(notes.conflict_reason(F.lit(" "), F.lit(0.934)).alias("r")).first()["r"]
    assert reason == "the same author already has a note on this paragraph that is 93% the same — probably an edit of it"
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    mine = spark.createDataFrame([("a", "9"), ("b", "8")], "path string, content string")
    after, refused = snapshots.saved(files, mine, snapshots.snapshot(spark.createDataFrame([("a", "1"), ("b", "x")], "path string, content string")))
    assert sorted(map(tuple, after.collect())) == [("a", "9"), ("b", "2")] and [tuple(r) for r in refused.collect()] == [("b", "changed")]


def test_cards_and_colours(spark):
    cards = spark.createDataFrame([(0, "../texts/one.html?v=2", "T", "S", "D"), (1, "one.html", "U", "", ""), (2, "two", "V", "", "")], "ord int, href string, title string, subtitle string, description string")
    pages = spark.createDataFrame([("texts/one.html",), ("two.html",), ("three.html",)], "page string")
    assert [(r["page"], r["title"]) for r in web.card_of(pages, cards).orderBy("page").collect()] == [("texts/one.html", "T"), ("three.html", None), ("two.html", "V")]
    colours = spark.createDataFrame([([1.0, 0.5, 0.0], "#A0b1C2"), ([0.2], "red"), ([0.1, 0.2], None), ([2.0, -1.0, 0.0, 0.5], "a0b1c2")], "s array<double>, t string")
    assert [tuple(r) for r in colours.select(spans.colour_of_shares("s"), spans.colour_of_text("t")).collect()] == [("#ff8000", "#a0b1c2"), ("#333333", ""), ("", ""), ("#ff0000", "#a0b1c2")]


def test_contained_against_brute_force(spark):
    """Words of few letters: texts of one and two words are found within words, at their ends and beginnings; a very long word and an empty text too."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("ab") for _ in range(r.choice([1, 2, 3, 9, 12])))
    small = [(i % 2, i, " ".join(word() for _ in range(r.choice([1, 1, 2, 2, 3, 4])))) for i in range(60)]
    large = [(i % 2, i, " ".join(word() for _ in range(r.randint(1, 12)))) for i in range(80)] + [(0, 999, "x" * 50_000 + " ab"), (1, 998, "")]
    found = match.contained(spark.createDataFrame(small, "doc_id int, q int, norm string"), spark.createDataFrame(large, "doc_id int, id int, norm2 string"), ["q"], ["id"])
    assert sorted((x.doc_id, x.q, x.id) for x in found.collect()) == sorted((d, q, i) for d, q, n in small for e, i, m in large if d == e and n in m)


def test_csv_cells_over_several_lines(spark):
    import csv
    import io

    cells = [["p1", "A", 'one\ntwo "quoted",\r\nthree'], ["p2", "", "plain"], ["p3", "B, C", '""'], ["p4", "x", "  "], ["p5", 'say "x"', "tab\there;\n\n\nend"], ["p6", "", 'word ' * 20_000 + '"' * 500]]
    for separator in ",\t;":
        out = io.StringIO()
        csv.writer(out, delimiter=separator).writerows([["\ufeffID", "Comment_Author", "Comment_Text"], *cells, [], ["p7", "short"]])
        text = "\n" * (separator == ";") + out.getvalue().replace("\ufeff", "")
        docs = spark.createDataFrame([("d", ("\ufeff" if separator == "," else "") + text), ("e", ""), ("f", "id,text")], "doc_id string, text string")
        found = {r["para"]: (r["author"], r["text"]) for r in annotation_files.from_csv(docs, separator).collect()}
        assert found == {p: (a.strip(), x.strip()) for p, a, x in cells if x.strip()}
    bare = spark.createDataFrame([("d", 'id,text\np,5" pipe\nq,a "b" c\n')], "doc_id string, text string")
    assert {r["para"]: r["text"] for r in annotation_files.from_csv(bare).collect()} == {"p": '5" pipe', "q": 'a "b" c'}


def test_lenient_notes_files(spark):
    files = {
        "strict": 'window.NOTES = {"p": [{"author": "A", "text": "one"}]};', "calls": 'addNote("p", "A", "one", "", "");', "renamed": 'let n = {"p": [{"text": " one ", "author": "A"}, {"text": " "}, 7], "q": {"text": "two"}, "r": "no"};',
        "raw": 'x = {"p": [{"text": "one\nline"}]}', "list": "x = [1]", "broken": 'x = {"p": [{"text": }', "inner": 'x = {"p": [{,}]}', "gone": None, "empty": "",
    }
    docs = spark.createDataFrame(list(files.items()), "doc_id string, text string")
    found = sorted((r["doc_id"], r["ord"], r["para"], r["author"], r["text"]) for r in annotation_files.from_notes_lenient(docs).collect())
    assert found == [("calls", 0, "p", "A", "one"), ("raw", 0, "p", "", "one line"), ("renamed", 0, "p", "A", "one"), ("renamed", 2, "q", "", "two"), ("strict", 0, "p", "A", "one")]
    errors = {r["doc_id"]: r["error"] for r in annotation_files.notes_errors(docs).collect()}
    assert errors == {"list": "does not look like a notes file", "broken": "could not be read as JSON", "inner": "could not be read as JSON", "empty": "does not look like a notes file"}
