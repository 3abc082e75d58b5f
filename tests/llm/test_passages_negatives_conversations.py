"""Operators 11 to 13 against brute force, on small tables with the awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import conversation_repair, hard_negatives, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# 11


def passages(rows):
    """(doc_id, text) to (doc_id, words, words removed, hash of the rest), window by window."""
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (d, _), ws in zip(rows, words, strict=True):
        for i in range(len(ws) - 49 if d is not None else 0):
            key = tuple(ws[i : i + 50])
            least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), ws in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(ws) - 49 if d is not None else 0):
            if least[tuple(ws[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(4)
    some = lambda n, words=4000: [f"w{rng.randrange(words)}" for _ in range(n)]
    common, page, spaced = some(57), some(400), some(49)
    rows = [(100 + i, " ".join(some(rng.randrange(90)) + common[rng.randrange(3) :] + some(rng.randrange(90)))) for i in range(60)]
    rows += [(7, " ".join(page)), (9, "\n".join(page)), (8, " ".join([*some(20), *page[100:180], *some(5), *page[200:249], "x", *page[250:300]])), (9, " ".join(some(60) + page[:70])), (9, "\n".join(page))]
    rows += [(1, None), (2, ""), (3, " \n\t "), (None, " ".join(page)), (4, " ".join(spaced)), (5, " ".join(spaced)), (6, " ".join([*spaced, "y"])), (10, "a " * 400), (11, "a " * 300 + "b"), (12, "ü ß 漢字 " * 60), (13, "x ü ß 漢字 " + "ü ß 漢字 " * 60)]
    return rows + [(14, "long " * 50_000 + " ".join(page[50:150])), (15, "z" * 3_000_000 + " " + " ".join(page[:60])), (-3, " ".join(common))]


@pytest.mark.parametrize("bucket", [substring_dedup.BUCKET, 3])
def test_repeated_passages(spark, bucket):
    """bucket 3: nearly all windows go out by fingerprint instead of being sorted in a task."""
    rows = texts()
    table = spark.createDataFrame([(*r, "clash", 1, b"x") for r in rows], "doc_id long, text string, kept string, row int, key binary").repartition(5)
    found = substring_dedup.deduplicated(table, bucket)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == passages(rows)


def test_repeated_passages_of_no_rows(spark):
    assert substring_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_are_cut_and_cover_every_window():
    words, where = np.repeat(np.arange(3, dtype=np.uint64), 500), np.array([0, 700, 720, 1500])
    row, start, n, *_ = substring_dedup._runs(words, where)
    assert n.max() <= substring_dedup.RUN
    assert sorted((r, s + i) for r, s, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True) for i in range(k)) == [(r, i) for r in (0, 2) for i in range(where[r + 1] - where[r] - 49)]


def test_long_texts_are_hashed_piece_by_piece(monkeypatch):
    data = np.frombuffer(("word " * 500 + "x" * 9000 + "\tend " * 300).encode(), np.uint8)
    whole = substring_dedup._hashes(data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    assert (substring_dedup._hashes(data, np.array([0, len(data)]))[0] == whole).all() and len(whole) == 801


# 12


def negatives(rows, every=100, share=80):
    scaled = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]
    out = []
    for a in sorted({i for i, *_ in scaled if i % every == 0}):
        mine = min((v, label) for i, label, v in scaled if i == a)
        scores = sorted((-sum(x * y for x, y in zip(mine[0], v, strict=True)), i, label) for i, label, v in scaled if i != a and len(v) == len(mine[0]))
        for s, p, _ in [x for x in scores if x[2] == mine[1]][:5]:
            fits = [x for x in scores if x[2] != mine[1] and share * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(i, v, label, "clash", 0) for i, label, v in rows], "vec_id long, embedding array<float>, label int, rank string, score int").repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mined(table, F.col("vec_id") % 100 == 0, **more).collect())


def groups(seed, n=700, dim=16):
    """Vectors near centres of mixed labels, of mixed lengths, with ties and repeated ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    rows = [(i, int(rng.integers(4)), ((centres[rng.integers(30)] + 0.2 * rng.normal(size=dim)) * rng.choice([0.1, 1, 1, 3])).round(2).tolist()) for i in range(n)]
    return [*rows, *((i + 1000, (label + 1) % 4, v) for i, label, v in rows[:60]), (300, 9, [0.0] * dim), (2000, 9, [0.0] * dim), (2001, 8, [0.0] * dim), (2100, 5, [1.0] * dim)]


@pytest.mark.parametrize("rows, block", [(hard_negatives.ROWS, hard_negatives.BLOCK), (40, 3)])
def test_hard_negatives(spark, monkeypatch, rows, block):
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    made = [r for r in groups(1) if r[0] != 300] + [(300, 9, [0.0] * 16)]
    found = mined(spark, made)
    assert found == negatives(made) and len(found) > 50


def test_hard_negatives_with_awkward_rows(spark):
    made = groups(2, 150)
    odd = [(400, 1, None), (401, None, [1.0] * 16), (402, 1, [float("nan")] * 16), (403, 1, [None] * 16), (None, 1, [1.0] * 16), (404, 1, []), (500, 1, [1.0, 2.0]), (501, 1, [1.0, 2.5]), (502, 2, [1.0, 2.25]), (503, 2, [1.0, 2.25])]
    good = [r for r in odd if r[0] is not None and r[0] >= 500]
    assert mined(spark, made + odd) == negatives(made + good)
    assert mined(spark, [(0, 1, [1e30, 0.0]), (1, 1, [1e30, 1.0]), (2, 2, [1e30, 0.0])]) == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]
    assert mined(spark, odd[:4]) == []


def test_feasible_ranges_keep_all_rows_that_may_count():
    """Of clustered vectors the focus coordinates leave few, and every row that reaches the need is among them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    centres /= np.sqrt((centres**2).sum(axis=1, keepdims=True))  # of one length, as in a bucket
    data = (256 * (centres[rng.integers(40, size=2000)] + 0.02 * rng.normal(size=(2000, 16)))).astype(np.int64)
    units = hard_negatives._units(data)
    orders = np.argsort(units, axis=0, kind="stable").T
    q, scores = data[:20], data[:20] @ data.T
    needs = 0.95 * np.diag(scores[:, :20])
    left = dict(hard_negatives.candidates(q, units[:20], needs, float(hard_negatives._lengths(data).max()), units, orders))
    for i in range(20):
        assert set(np.flatnonzero(scores[i] >= needs[i])) <= set(left.get(i, np.zeros(0, int)).tolist())
    assert np.mean([len(x) for x in left.values()]) < 600


# 13

SOUND = re.compile(r"(s?(ua)+)?")


def edited(rows):
    """Cheapest (cost, audit, repaired lines) of rows (role, text, must go, truncated), by trying whole sequences of edits, the cheapest first."""
    import heapq

    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(lines)
        moves = [(2, "I", i, r, f"{n}:") for r, n in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            role, text, must, cut = rows[i]
            moves.append((3, "D", i + 1, None, None))
            if not must:
                moves.append((int(cut), "K", i + 1, role[:1], f"{role}:{text}"))
                moves += [(2 + cut, "R", i + 1, r, f"{n}:{text}") for r, n in (("u", "user"), ("a", "assistant"))]
        for c, e, j, r, line in moves:
            q = state if r is None else steps.get((state, r))
            if q is not None:
                heapq.heappush(heap, (cost + c, audit + e, j, q, lines if r is None else (*lines, line)))


def conversations(rows, damage=True):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        found[conv]
        if how:
            found[conv] += [(turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)] * (2 if how == 3 else 1)
    out = []
    for conv, xs in found.items():
        xs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in xs:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in xs} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(xs))
        cost, audit, lines = edited([(role, text, f in ("blank", "duplicate"), f == "truncated") for (_, role, text), f in zip(xs, faults, strict=True)])
        assert SOUND.fullmatch("".join(x[0] for x in re.findall(r"(?m)^(?:system|user|assistant|u2|sy)(?=:)", lines)))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk():
    rng = random.Random(8)
    text = lambda: rng.choice(["Yes.", "No!", "cut", "so on\x0b", "Why? ", " \t", "", "ü", "“x”", f"Line {rng.randrange(9)}."])
    rows = [(c, t * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "user", "assistant"]), text()) for c in range(40) for t in range(rng.randrange(1, 14))]
    rows += [(99, t, ("user", "assistant")[t % 2], f"Well {t}.") for t in range(150)] + [(99, 77, "system", "In between."), (99, 3, "user", "same."), (99, 4, "user", "same."), (99, 120, "user", "same.")]
    rows += [(50, None, None, None), (50, None, "user", "Hi."), (50, 4, "", "No role."), (50, 5, "tool", "Called."), (50, 6, "u2", "Me."), (None, 1, "user", "A."), (None, None, "assistant", "B."), (0, 1, "user", "Zero."), (51, None, "system", "Only.")]
    return rows + [(52, 9, "user", "Same."), (52, 9, "user", "Same."), (52, 9, "assistant", "Other."), (53, 1, "user", "long " * 100_000 + "."), (53, 2, "assistant", "long " * 100_000)]


@pytest.mark.parametrize("held", [conversation_repair.PART, 0, 5])
def test_conversations(spark, monkeypatch, held):
    """held 0 and 5: (longer) conversations are parsed in parts of a few rows, which are combined."""
    monkeypatch.setattr(conversation_repair, "PART", max(3, min(held, 7)))
    rows = [r for r in talk() if r[0] != 0 or r[1] is not None]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, pos int").repartition(6)
    damaged = conversation_repair.damaged(table)
    found = conversation_repair.repaired(damaged, held).collect()
    want = {r[0]: r for r in conversations(rows)}
    assert {r["conv_id"]: tuple(r) for r in found} == {k: v for k, v in want.items() if k in {r["conv_id"] for r in found}}
    if held:
        assert sorted((tuple(r) for r in conversation_repair.checked(table).collect()), key=repr) == conversations(rows)


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.checked(empty).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    row = conversation_repair.checked(spark.createDataFrame([(5, gone, "user", "Hi.")], empty.schema)).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def grammar_cell(codes):
    """The cell of a span by all splits, in the grammar's plain form."""
    n = len(codes)
    cells = {(i, i + 1): conversation_repair._short(c) for i, c in enumerate(codes)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            found = {}
            for k in range(i + 1, i + size):
                for key, x in conversation_repair.combined(cells[i, k], cells[k, i + size]).items():
                    found[key] = min(found.get(key, x), x)
            cells[i, i + size] = found
    return cells[0, n]


def test_one_split_of_a_span_is_enough():
    rng = random.Random(2)
    for _ in range(60):
        codes = "".join(rng.choice("suaxdSUAX") for _ in range(rng.randrange(1, 19)))
        assert conversation_repair.cell(codes) == grammar_cell(codes)
