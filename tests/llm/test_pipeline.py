"""The pipeline's stages against brute force, each on what the one before it kept."""

import corpus_pipeline
from test_operators import base_spans, brute_components

from quire.llm._base import cut, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], SF), name))
    for df in kept[1:-1]:
        assert tuple(df.columns) == corpus_pipeline.COLUMNS
    first, good, single, clean, mix, packed = ([r.asDict() for r in df.collect()] for df in kept)
    bad = {r["doc_id"] for r in table(spark, SF, "labels").filter("quality = 0").collect()}
    gone = {r["doc_id"] for r in first} - {r["doc_id"] for r in good}
    assert len(gone) < 0.25 * len(first) and len(bad & gone) > 0.8 * len(bad & {r["doc_id"] for r in first})
    found = brute_components([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted(i for i, _, c in found if i == c)
    assert [r["doc_id"] for r in sorted(clean, key=lambda r: r["doc_id"])] == sorted(r["doc_id"] for r in single)
    assert not any(base_spans(r["text"]) for r in clean)
    same = {r["doc_id"]: r["text"] for r in single}
    assert all(r["text"] == same[r["doc_id"]] for r in clean if not base_spans(same[r["doc_id"]]) and "[" not in r["text"])
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(words(mix) - words(clean)) <= 0.01 * words(clean)
    assert all(r["n_chars"] == len(r["text"]) for r in mix)
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mix}
    for places in sequences.values():
        assert sum(n for _, n in places) == max(o + n for o, n in places) <= 2048


ODD = [
    (1, "The first document has enough words to be one of those that are kept.", "en", "a", 70), (1, "The first document has enough words to be one of those that are kept.", "en", "a", 70), (2, None, None, None, None), (3, "", "en", "a", 0),
    (4, " \n\t ", "de", "b", 4), (None, "A text without an id, mail me at someone@example.org or call +49 30 1234567.", "en", None, None), (None, "A text without an id, mail me at someone@example.org or call +49 30 1234567.", "en", None, None),
    (5, "long words " * 40_000, "en", "b", 440_000), (6, "x" * 200_000, "en", "c", 200_000), (7, "ünï 漢字 😀 and the card 4111 1111 1111 1111 here", "xx", "c", 47), (8, "long words " * 40_000, "en", "b", 440_000),
]


def test_stages_with_awkward_rows(spark):
    """Null and repeated ids, null, empty and very long texts: each stage has a defined result, and an empty table stays one."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, rows: stages[name](spark, rows, SF).collect()
    assert all(run(name, docs.filter("false")) == [] for name in stages)
    good = run("quality", docs)
    assert {(r["doc_id"], r["text"]) for r in good} <= {r[:2] for r in ODD}
    single = [r["doc_id"] for r in run("near_duplicates", docs)]
    assert sorted(x for x in single if x is not None) == [1, 2, 3, 4, 5, 6, 7] and single.count(None) >= 1
    clean = run("personal_data", docs)
    assert sorted(str(r["doc_id"]) for r in clean) == sorted(str(r[0]) for r in ODD)
    for r in clean:
        assert r["text"] is not None and "someone@example.org" not in r["text"] and "4111" not in r["text"] and (r["doc_id"] != 5 or r["text"] == ODD[7][1])
    mix = run("mixture", docs)
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert not {2, 3, 4} & {r["doc_id"] for r in mix} and 0 < words(mix) and all(r["text"] for r in mix)
    packed = run("packing", docs)
    assert {r["doc_id"] for r in packed} == {r[0] for r in ODD} and max(r["offset"] + r["length"] for r in packed) <= 2048
    texts = {}
    for r in packed:
        texts[r["doc_id"]] = texts.get(r["doc_id"], 0) + r["length"]
    assert texts[2] == texts[3] == 1 and texts[5] == texts[8] > 40_000
