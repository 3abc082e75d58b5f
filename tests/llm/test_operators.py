"""Each operator against brute force on small tables with the awkward rows: nulls, empty and very long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import html as html_lib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from comparison import duck, same
from pyspark.sql import functions as F

from quire.llm import _base, components, html, mixing, neardup, ngram_join, packing, pii, quality, queries, search, token_counts, urls

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 20_000
DOC = "doc_id long, text string, source string, size string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [
        (1, "one two three four five six", "a"), (2, None, "a"), (3, "", "b"), (4, " \t\n ", "b"), (5, LONG, "c"), (6, "One two three four FIVE six", None), (6, "One two three four FIVE six", None),
        (7, "one two three four five six seven", "b"), (None, "no id here at all, none", "a"), (8, "few words", ""), (9, "few words", ""), (10, "x" * 300_000, "c"), (11, "ünï 漢字 😀 mail me at a.b@c.de or +49 (30) 1234-5678", None),
    ]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOC)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), duck(SF), queries.SQL[name])


# 1


def test_top_k(spark):
    random = np.random.default_rng(0)
    made = [(i, random.normal(size=8).round(2).tolist(), 0) for i in range(150)] + [(200, [0.5] * 8, 0), (201, [0.5] * 8, 0), (202, [0.5] * 8, 0)]
    odd = [(300, None, 0), (350, [float("nan")] * 8, 0), (301, [None] * 8, 0), (None, [1.0] * 8, 0), (400, [float("inf")] + [0.0] * 7, 0), (450, [1.0, 2.0], 0), (302, [], 0)]
    table = vectors(spark, made + odd)
    found = defaultdict(list)
    for r in search.top_k(table, table.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in made}
    for i in (0, 50, 100, 200):
        scores = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i))[:5]
        assert found[i] == [(k, j, -s) for k, (s, j) in enumerate(scores, 1)]
    assert set(found) == {0, 50, 100, 200}


def test_top_k_few_and_none(spark):
    table = vectors(spark, [(0, [1e30, 1.0], 0), (1, [1e30, 2.0], 0), (1, [1.0, 1.0], 0)])
    rows = search.top_k(table, table.filter("vec_id = 0"), 5).collect()
    assert [(r["vec_id"], r["rank"]) for r in rows] == [(1, 1), (1, 2)] and rows[0]["score"] == 2**63 - 1
    assert search.top_k(table.filter("false"), table.filter("false"), 5).count() == 0


# 2


def test_mix(spark, awkward):
    rows = mixing.mix(awkward, seed="x").collect()
    assert len(rows) == awkward.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, full = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weights[s] for s in weights if s not in full)
        more = {s for s in weights if weights[s] * level > 3 * sizes[s]}
        if more <= full:
            break
        full |= more
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], min(weights[r["source"]] * level, 3 * sizes[r["source"]]))
        assert abs(taken[r["source"]] - r["target"]) <= 3
    again = mixing.mix(awkward.repartition(7), seed="x").select("doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(awkward, seed="x").select("doc_id", "taken").collect())
    assert mixing.mix(awkward.filter("false")).count() == 0


def test_mixed_rows(spark, awkward):
    small = awkward.filter("length(text) < 1000 or text is null")
    want = Counter()
    for r in mixing.mix(small).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed(small).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert +want == got


# 3

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- c --><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>First
   line.<br><p>Second &lt;x&gt; &#233;.</p><div class="ad">Buy</div><form><input>Sign up</form><aside>Side</aside><p>Short.</p></article>
<div class="comments"><article class="comment"><p>A reader comment that is rather long, longer than the article itself may be.</p></article></div><footer>&copy; F</footer></body></html>"""


def test_html():
    assert html.main_text(PAGE) == "Title & more\n\nFirst line.\n\nSecond <x> é.\n\nShort."
    plain = "<body><div><ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul></div><div><p>" + "Long text of the page. " * 10 + "</p><p>And the end of it all.</p></div><div class=sidebar>Other</div></body>"
    assert html.main_text(plain) == ("Long text of the page. " * 10).strip() + "\n\nAnd the end of it all."
    for broken in (None, "", "<", "<p", "&amp", "<![CDATA[x", "</p></div>", "<article><p>a", "<nav>never closed<article><p>a</p></article>", "<!--"):
        assert html.main_text(broken) in ("", "a", "&", "<", "<p")
    assert html.main_text("plain text only") == "plain text only"
    assert html.main_text("<article>" + "<div>" * 2000 + "deep" + "</div>" * 2000) == "deep"


def test_html_regions():
    words = "Some words of the story that go on for a while. "
    cases = {
        '<script>var a="<!--";</script><article><p>Hello world</p>': "Hello world",
        f"<div><a href=x>Home<p>{words * 3}</p><p>{words * 2}</p></div>": f"{(words * 3).strip()}\n\n{(words * 2).strip()}",
        f"<body><article><p>{words * 6}</p></article><article><p>{words * 4}</p></article></body>": f"{(words * 6).strip()}\n\n{(words * 4).strip()}",
        f"<div><div><p>{words * 9}</p><p>{words * 8}</p></div><article><p>Teaser one</p></article><article><p>Teaser two</p></article></div>": f"{(words * 9).strip()}\n\n{(words * 8).strip()}",
        f"<main><h1>T</h1><p>{words}</p><article><p>{words * 3}</p></article></main>": f"T\n\n{words.strip()}\n\n{(words * 3).strip()}",
        f"<div><h1>Title of it</h1><p>{words * 3}</p><blockquote>{words * 7}</blockquote></div>": f"Title of it\n\n{(words * 3).strip()}\n\n{(words * 7).strip()}",
        f'<article><section id="related-work"><p>{words}</p></section><div class="notice-of-rights"><p>Rights</p></div><div class="search-methods">{words}</div></article>': f"{words.strip()}\n\nRights\n\n{words.strip()}",
        f'<article><p class="ad">Buy<p>{words}</p><ul><li class="advert">Buy</li><li>Point</li></ul><p>It <span class="cookie-notice">We use</span>is <math><mi>x</mi></math> here.</p></article>': f"{words.strip()}\n\nPoint\n\nIt is x here.",
    }
    for page, text in cases.items():
        assert html.main_text(page) == text, page


LONG_BLOCK = "This long paragraph goes on and on with many words about the matter at hand. " * 50


def test_html_short_blocks_beside_long_ones():
    short = lambda a, n: [f"{a} short line {i}." for i in range(n)]
    page = lambda *parts: "<html><body>" + "".join(f"<p>{x}</p>" for x in parts) + "</body></html>"
    whole = [*short("a", 12), LONG_BLOCK.strip(), *short("b", 12)]
    assert html.main_text(page(*whole)) == "\n\n".join(whole)
    assert html.main_text(page(*["Hi there."] * 20, LONG_BLOCK).replace("<body>", "<body><h1>T</h1>")) == "\n\n".join(["T", *["Hi there."] * 20, LONG_BLOCK.strip()])
    linked = f"<body><p>{LONG_BLOCK}</p><a href=x><p>A paragraph in a link between two others.</p></a><p>{LONG_BLOCK}</p><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul></body>"
    assert html.main_text(linked) == "\n\n".join([LONG_BLOCK.strip(), "A paragraph in a link between two others.", LONG_BLOCK.strip()])


@pytest.mark.parametrize("part, kept", [
    ('<section class="search"><p>We searched PubMed for trials of the drug.</p></section>', True), ('<section class="related"><h2>Related work</h2><p>It was done by others.</p></section>', True),
    ('<div class="notice"><p>The parties gave notice of the terms in May.</p></div>', True), ("<menu><li>First item of the content</li></menu>", True), ("<aside><p>A quotation from the article stands here in the middle.</p></aside>", True),
    ('<div class="comment-thread"><div><b>Ann</b><p>Nice post, thanks!</p></div><div><b>Bob</b><p>I disagree.</p></div></div>', False), ('<section id="discussion"><div><b>Ann</b> <p>Nice!</p></div><div><b>Bob</b> <p>Me too.</p></div></section>', False),
    ('<ol class="commentlist"><li>Great!</li><li>Thanks for it</li></ol>', False), ('<div class="ad-slot-300x250"><p>Buy now the best shoes</p></div>', False), ('<div class="related"><a href=a>Other story of the day</a> <a href=b>And one more of them</a></div>', False),
    ('<div class="search"><input name=q><p>Type what you look for here.</p></div>', False), ("<aside><h4>See also</h4><p>Something else to read in another place.</p></aside>", False), ("<menu><li><a href=a>Home page</a></li></menu>", False),
])
def test_html_doubtful_elements(part, kept):
    """Within an article a name alone decides nothing that it may not mean; of what is kept, all."""
    inner = [" ".join(re.sub("<[^>]+>", "", x).split()) for x in re.split("</(?:p|li|h2|h4|b)>", part)]
    for page in ("<body><article><h1>T</h1><p>{0}</p>{1}<p>{0}</p></article></body>", "<body><nav><a href=x>n</a></nav><article><p>{0}</p>{1}<p>{0}</p></article></body>"):
        found = html.main_text(page.format(LONG_BLOCK, part)).split("\n\n")
        assert [x for x in found if x not in ("T", LONG_BLOCK.strip())] == ([x for x in inner if x] if kept else [])
    outside = html.main_text(f"<body><article><p>{LONG_BLOCK}</p></article>{part}</body>")
    assert outside == LONG_BLOCK.strip()


def test_html_known_pages():
    """Pages without article elements, made of known blocks and known surroundings."""
    random = np.random.default_rng(5)
    words = "the of and court state party shall provision article law right under case order".split()
    text = lambda n: (" ".join(random.choice(words, n)) + ".").capitalize()
    for k in range(30):
        blocks = [text(int(random.choice([4, 8, 25, 60, 200]))) for _ in range(int(random.integers(4, 25)))]
        blocks[len(blocks) // 2] = text(120)
        body = "".join(f"<{t}>{x}</{t}>" for x in blocks for t in [random.choice(["p", "p", "p", "h2"])])
        links = "".join(f'<li><a href="/{i}">{text(2)}</a></li>' for i in range(6))
        around = (f"<nav><ul>{links}</ul></nav><div class='ad'>{text(9)}</div>", f"<div class='comments'><div><p>{text(12)}</p></div><div><p>{text(9)}</p></div></div><footer>&copy; {text(5)}</footer>")
        page = f"<html><head><title>x</title></head><body>{around[0]}<div id='c{k}'>{body}</div>{around[1]}</body></html>"
        assert html.main_text(page) == "\n\n".join(blocks), page


def test_html_deep():
    page = "<div>x" * 100_000
    began = time.time()
    assert html.main_text(page).count("x") == 100_000 and time.time() - began < 60


def test_html_pages(spark):
    rows = html.extracted(_base.table(spark, SF, "pages").withColumns({"text": F.lit(1), "n_chars": F.lit(1)})).collect()
    pages = {r["page_id"]: r["html"] for r in _base.table(spark, SF, "pages").collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = (" ".join(html_lib.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body))
        assert r["text"] == "\n\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"])
    assert html.extracted(_base.table(spark, SF, "pages").filter("false")).count() == 0


# 4


def test_quality(spark):
    d = SF.replace("0.001", "0.01")
    labels = _base.table(spark, d, "labels")
    scored = quality.classified(_base.table(spark, d, "documents").withColumn("score", F.lit("x")), labels)
    rows = {r["doc_id"]: r for r in scored.collect()}
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(r["held_out"] and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r, _ in held)
    assert sum(r["predicted"] == q for r, q in held) / len(held) > 0.95
    flipped = quality.classified(_base.table(spark, d, "documents"), labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert all(abs(r["score"] - rows[r["doc_id"]]["score"]) < 1e-9 for r in flipped.collect())  # held-out labels change nothing


def test_quality_awkward(spark, awkward):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classified(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert {r["score"] for r in quality.classified(awkward, labels.filter("false")).collect()} == {0.5}
    assert quality.classified(awkward.filter("false"), labels).count() == 0


def test_quality_rows_stand_alone():
    texts = ["a b", "b c c", "", "c Dd dd", None, "x", "x x 12!", " lead", LONG, "É é é"]
    whole = list(quality.features(*_base.text_bytes(pa.array(texts))))
    for text, found in zip(texts, whole, strict=True):
        assert sorted(found) == sorted(next(quality.features(*_base.text_bytes(pa.array([text], pa.string())))))


# 5


def sets_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(low))
        out.append((doc_id, frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()))
    return out


def brute_components(rows):
    sets = [(i, s) for i, s in sets_of(rows) if i is not None]
    top = {i: i for i, _ in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and root(a) != root(b):
                top[max(root(a), root(b))] = min(root(a), root(b))
    return Counter((i, len(s), root(i) if i is not None else None) for i, s in sets_of(rows))


def check_join(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(df).collect())
    assert found == brute_components(rows)


def test_join_awkward(spark, awkward):
    check_join(awkward)
    assert ngram_join.joined(awkward.filter("false")).count() == 0
    kept = ngram_join.deduplicated(awkward)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 10, 11]


def test_join_near_copies(spark):
    random = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(4000)])
    rows, n = [], 0
    for size in (5, 9, 30, 120, 400, 1500):
        for _ in range(4):
            base = random.choice(words, size)
            for k in range(6):
                text = base.copy()
                for i in random.integers(0, size, int(size * 0.008 * k)):
                    text[i] = random.choice(words)
                rows.append((n, " ".join(text)))
                n += 1
    shared = " ".join(random.choice(words, 40))
    for _ in range(60):
        rows.append((n, shared + " " + " ".join(random.choice(words, random.integers(1, 200)))))
        n += 1
    rows += [(3, rows[40][1]), (n + 1, rows[7][1])]  # an id with two texts, a copy
    check_join(spark.createDataFrame(rows, "doc_id long, text string"))


def truth_of(sets):
    return {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 5 * (k := len(np.intersect1d(x, y))) >= 4 * (len(x) + len(y) - k)}


def test_tree_finds_all():
    random = np.random.default_rng(2)
    base = [random.integers(0, 1 << 62, random.integers(20, 600), dtype=np.int64).astype(np.uint64) for _ in range(30)]
    sets = [np.unique(np.where(random.random(len(b)) < 0.08, random.integers(0, 1 << 62, len(b), dtype=np.int64).astype(np.uint64), b)) for b in base for _ in range(5)]
    truth = truth_of(sets)
    found = {(max(i, j), min(i, j)) for i, hit in ngram_join.candidates(np.array([len(s) for s in sets]), [ngram_join.counts(s) for s in sets]) for j in hit.tolist()}
    assert truth and truth <= found and len(found) < len(sets) ** 2 / 10
    up = dict(components.merged([(j, i) for i, j in truth]))
    got = dict(components.merged(ngram_join.links_among(sets, np.arange(len(sets)))))
    assert [up.get(i, i) for i in range(len(sets))] == [got.get(i, i) for i in range(len(sets))]


def test_join_hot_cells(spark, monkeypatch):
    """Families within and below the threshold, a passage that most texts share, with cells split into small blocks."""
    random = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(20_000)])
    base, template, passage = random.choice(words, 200), random.choice(words, 300), random.choice(words, 50)
    rows = []
    for _ in range(150):
        near, low = base.copy(), template.copy()
        near[random.integers(0, 200, 2)] = random.choice(words, 2)
        low[10 + 40 * np.arange(7)] = random.choice(words, 7)  # in pairs about 0.78
        rows += [" ".join(near), " ".join(low), " ".join([*random.choice(words, random.integers(5, 80)), *passage, *random.choice(words, random.integers(5, 80))])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for block in (1024, 64):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        check_join(docs)
    check_join(docs.limit(300))


def test_join_exact_prefix(spark):
    docs = _base.table(spark, SF, "documents")
    assert sorted(ngram_join.joined(docs, prefix=None).collect()) == sorted(ngram_join.joined(docs).collect())


# 6


def test_near_duplicates(spark):
    random = np.random.default_rng(3)
    base = random.normal(size=(40, 16))
    made = [(i, (base[i % 40] + random.normal(size=16) * (0.12 if i % 3 else 0.02)).tolist(), i % 40 % 3) for i in range(1500)]
    made += [(2000 + i, made[5][1], made[5][2]) for i in range(30)]
    odd = [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, made[0][1], None), (None, made[0][1], 0), (3004, made[0][1][:8], 0), (3005, [1e300 * 0] * 15 + [None], 0), (3006, [], 0)]
    found = {r["vec_id"]: r for r in neardup.near_duplicates(vectors(spark, made + odd)).collect()}
    x = np.array([np.array(v, np.float32).astype(float) for _, v, _ in made])
    unit, label, ids = x / np.linalg.norm(x, axis=1)[:, None], np.array([m[2] for m in made]), np.array([m[0] for m in made])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    got = sum(found[i]["n_links"] for i in ids)
    assert 0.98 * near.sum() <= got <= near.sum()
    up = dict(components.merged([(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near), strict=True)]))
    assert np.mean([found[i]["component_id"] == up.get(i, i) for i in ids.tolist()]) > 0.99
    for i in (3000, 3001, 3002, 3003, 3004, 3005, 3006):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)
    assert len(found) == len(made) + len(odd) and neardup.near_duplicates(vectors(spark, odd[:1]).filter("false")).count() == 0


def grouped(n, size, dim=64, seed=0):
    """n unit vectors, half of them in groups of so many near copies."""
    random = np.random.default_rng(seed + n)
    near = np.repeat(random.normal(size=(n // 2 // size + 1, dim)), size, axis=0)[: n // 2]
    x = np.concatenate([near + 0.15 * random.normal(size=near.shape), random.normal(size=(n - n // 2, dim))])[random.permutation(n)]
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("n, size", [(1500, 3), (3000, 3), (6000, 3), (3000, 20), (6000, 20), (3000, 300), (6000, 300), (16384, 20)])
def test_graph_alone(n, size):
    """Nodes find themselves, and a search with the first beam finds the links, also in groups larger than it."""
    x = grouped(n, size)
    graph = neardup.Graph.build(x)
    assert len(graph.lost()) <= n // 2000
    truth = x @ x.T >= 0.93
    np.fill_diagonal(truth, False)
    found = np.zeros_like(truth)
    for i, nodes in graph.near(x, 0.93, neardup.BEAM):
        found[i, nodes] = True
    np.fill_diagonal(found, False)
    assert not (found & ~truth).any() and (found & truth).sum() >= 0.995 * truth.sum()
    pairs = neardup.Pairs(graph, graph)
    hits, links = pairs.found(0.93)
    counts = np.random.default_rng(1).integers(1, 4, n)
    of_a, of_b, forest = pairs.summed(counts, counts)
    got = pairs.rows(np.arange(n))
    assert hits >= 0.99 * links and (got == got.T).all() and (of_a == got @ counts).all() and (of_b == of_a).all()
    assert dict(components.merged(forest)) == dict(components.merged(zip(*(x.tolist() for x in np.nonzero(got)), strict=True)))


def test_near_duplicates_against_sql(spark, tmp_path):
    """A table that has links, in several shards: equal to its SQL."""
    x = grouped(1600, 5, 24)
    rows = [(i, v.tolist(), i % 7 % 2) for i, v in enumerate(x)] + [(5000 + i, x[i].tolist(), i % 7 % 2) for i in range(40)] + [(6000, None, 1), (6001, [0.0] * 24, 1), (6002, x[3].tolist(), None)]
    vectors(spark, rows).coalesce(1).write.parquet(str(tmp_path / "t"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/t/*.parquet')")
    found = neardup.near_duplicates(spark.read.parquet(str(tmp_path / "t")), shard_rows=400)
    assert found.filter("n_links > 0").count() > 500
    same(found, con, queries.SQL["op6_embedding_near_dup"])


def test_near_duplicates_over_shards(spark):
    """One label of several thousand vectors over several graphs: the links of vectors that have any."""
    random = np.random.default_rng(9)
    base = random.normal(size=(1500, 24))
    made = [(i, (base[i % 1500] + random.normal(size=24) * 0.15).tolist(), 1) for i in range(4500)] + [(i, random.normal(size=24).tolist(), 1) for i in range(4500, 5500)]
    found = {r["vec_id"]: r for r in neardup.near_duplicates(vectors(spark, made), shard_rows=1400).collect()}
    x = np.array([np.array(v, np.float32).astype(float) for _, v, _ in made])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    truth = near.sum(axis=1)
    got = np.array([found[i]["n_links"] for i in range(len(made))])
    assert (got <= truth).all() and got.sum() >= 0.995 * truth.sum() > 1000 and got.sum() % 2 == 0
    assert all(r["recall"] >= 0.9 for r in found.values())


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


# 7


def test_urls(spark):
    cases = {
        "http://WWW.Example.ORG/es/1?x": ("www.example.org", "/es/1", "example.org/es/", "block"), "https://example.org/en/17#a": ("example.org", "/en/17", "example.org/en/1", "block"), "https://a.b.org/": ("a.b.org", "/", "org/", "allow"),
        "ftp://x.com/fr/a/b?c=/d": ("x.com", "/fr/a/b", "com/fr/", "allow"), "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.org": ("x.org", "", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None), "http://ÄX.com/fr": ("Äx.com", "/fr", None, None), "://": ("", "", None, None), "http://x.net/" + "a" * 5000: ("x.net", "/" + "a" * 5000, None, None),
    }
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*cases, "http://x.com/de/"])], "page_id long, url string, rule string")
    for r in urls.judged(rows).collect():
        host, path, rule, verdict = cases[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert urls.judged(rows.filter("false")).count() == 0


def test_url_model(spark):
    """Against the same smoothed model by counting in plain Python."""
    pages = _base.table(spark, SF, "pages").select("page_id", "url")
    rows = urls.judged(pages).collect()
    grams = lambda s: [("\x02" * 4 + s + "\x03")[i : i + 5] for i in range(len(s) + 1)]
    n = {k: Counter() for k in ("allow", "block")}
    seen = set()
    for r in rows:
        s = r["url"] or ""
        seen.update(grams(s))
        if r["rule"] and int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % 5:
            n[r["verdict"]].update(grams(s))

    def chance(kind, tail, order, alphabet):
        context = tail[:-1]
        less = chance(kind, tail[1:], order - 1, alphabet) if order else 1 / alphabet
        follow = {g[-1] for g in n[kind] if g[4 - order : 4] == context}
        total = sum(v for g, v in n[kind].items() if g[4 - order : 4] == context)
        own = sum(v for g, v in n[kind].items() if g[4 - order :] == tail)
        return (own + len(follow) * less) / (total + len(follow)) if total else less

    alphabet = len({g[-1] for g in seen})
    for r in rows[:8]:
        want = np.mean([math.log(chance("allow", g, 4, alphabet)) - math.log(chance("block", g, 4, alphabet)) for g in grams(r["url"] or "")])
        assert abs(want - r["score"]) < 1e-5


# 8


def test_token_counts(spark, awkward):
    from tokenizers import Tokenizer, models, pre_tokenizers

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    words = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
    least = min(s for _, s in words)
    for known in (True, False):
        tokenizer = Tokenizer(models.Unigram([("<unk>", least), *words, *([(f"<0x{b:02X}>", least) for b in range(256)] if known else [])], unk_id=0, byte_fallback=known))
        tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        count = token_counts.Counter(words, known).count
        random = np.random.default_rng(5)
        made = ["".join(random.choice(["a", "th", "the ", " ", "  ", "\n", "é", "漢", "😀", "▁", "ing", "xq"], random.integers(0, 50))) for _ in range(400)]
        for text in [*made, "", " ", "▁", "x" * 3000]:
            assert count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text
    rows = token_counts.counted(awkward).collect()
    assert len(rows) == awkward.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}


# 9


def test_packing(spark, awkward):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = [r["text"] for r in awkward.collect()] + ["<|endoftext|> x", "a  b\n\n c 　d", "it's I'LL ’s 12½ ٣"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.packed(docs).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids) and (len(by[i]) == 1 if len(ids) <= 2048 else len(by[i]) == -(-len(ids) // 2048))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(docs.filter("false")).count() == 0


def test_packing_is_tight():
    sizes = np.sort(np.random.default_rng(4).integers(1, 2049, 8000))[::-1]
    bins, offsets = packing.sum_of_squares(sizes)
    ends = Counter()
    for b, s in zip(bins.tolist(), sizes.tolist(), strict=True):
        ends[b] += s
    assert max(ends.values()) <= 2048 and len(ends) <= 1.02 * sizes.sum() / 2048


# 10

KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d) % 10 + 2 * d // 10 for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans)


def test_pii(spark, awkward):
    random = np.random.default_rng(6)
    bits = ["a.b@c.de", "@", "x@y", "x@y@z.com", "a@b.c_d@e.f", ".", "1", "12", " ", "-", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "(", ")", "é", "😀", "\n", "256.1.1.1", "1.2.3.4", "1.2.3.4.5", "001.02.3.4", "--", "  ", "x", "99999999999999999999", "@a-b.c", "%"]
    made = ["".join(random.choice(bits, random.integers(0, 14))) for _ in range(1500)] + ["1 " * 3000, "a" * 100_000, "1" * 50_000, "a@b." + "c." * 5000, "+1" * 3000, "x@y.z " * 1500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(made)] + [(None, None)], "doc_id long, text string")
    for r in pii.report(docs).collect():
        text = made[r["doc_id"]] if r["doc_id"] is not None else ""
        spans = base_spans(text)
        assert r["base_sha256"] == hashlib.sha256(listed(spans).encode()).hexdigest(), text[:200]
        assert [r[f"n_{k}"] for k, _ in KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(filter(None, listed(spans).split(","))) <= set(r["spans"].split(","))
    assert pii.report(awkward).count() == awkward.count() and pii.report(awkward.filter("false")).count() == 0


def test_redaction(spark, awkward):
    rows = {r["doc_id"]: r["text"] for r in pii.redacted(awkward).collect()}
    assert rows[11] == "ünï 漢字 😀 mail me at [EMAIL] or [PHONE]" and rows[1] == "one two three four five six" and rows[2] == ""


def test_pii_many_matches(spark):
    """Time in proportion to the matches of one text, and all of them found."""
    took = []
    for n in (2_000, 100_000):
        text = " ".join(f"a{i}@b.de" for i in range(n))
        docs = spark.createDataFrame([(1, text), (None, "a@b.de"), (1, text[:20])], "doc_id long, text string")
        began = time.time()
        rows = pii.report(docs).collect()
        took.append(time.time() - began)
        assert sorted(r["n_email"] for r in rows)[-1] == n
    assert took[1] < 60 + 5 * took[0]
    assert max(len(r["text"]) for r in pii.redacted(docs).collect()) == 100_000 * 8 - 1


def test_wider_spans(spark):
    rows = [(i, f"some text {i} mail: user{i}@site{i % 7}.com and tel: (555) 555-{1000 + i} or order no: {10**15 + i} here") for i in range(300)] + [(1000, "write to jane.doe [at] example.org please")]
    found = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("phone:" in s for s in found.values()) > 250
    assert all("card" not in s or luhn(str(10**15 + i)) for i, s in found.items())


# Shared parts.


def test_word_hashes():
    column = pa.array(["the cat  sat", "", None, "The CAT sat", "thecat", " the\n", "é é"])
    hashes, at = _base.word_hashes(*_base.text_bytes(column))
    assert np.diff(at).tolist() == [3, 0, 0, 3, 1, 1, 1] and hashes[0] == hashes[7] and hashes[0] != hashes[3] and hashes[2] == hashes[5]
    low, _ = _base.word_hashes(*_base.text_bytes(column), lower=True)
    assert (low[:3] == low[3:6]).all()
    whole = list(ngram_join.shingle_sets(*_base.text_bytes(pa.array(["a b c d e f", "x", LONG]))))
    assert [len(x) for x in whole] == [2, 1, 5]
