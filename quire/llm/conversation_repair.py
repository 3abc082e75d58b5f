"""Repair of a conversation's structure: weighted interval parsing of its rows by a grammar of edits.

The roles that a sound conversation may have, (s?(ua)+)?, are a grammar in Chomsky normal form whose symbols are pairs of
states: (p, q) derives what leads from p to q, by (p, q) -> (p, r) (r, q), or by one edit of one row. A cell of a span holds for
each symbol the cheapest (cost, audit); inserted rows are a closure, so that each cell already has the best insertions before,
between and after its rows. Cells are combined bottom-up by span length, from rows to pairs to fours. Every symbol splits at
every place within its span, and all splits give the same cell, so one split of a span is enough and spans that no
cell needs aren't filled. That order of (cost, audit) survives joining: of two audits of one span and cost none begins the other,
since it would have to go on with insertions only, which cost.

Rows are dealt by ranges of (conversation, turn), so that a long conversation lies in several tasks. What lies whole within a
range is done there; of the rest each task parses its part, and the parts' cells are combined like any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import cut

#: Costs of the edits, and of an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: From state to state by a role: 0 nothing yet, 1 after the system row, 2 after a user's, 3 after an assistant's.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
#: Initials of roles that may follow one another.
SOUND = ("su", "ua", "au")
Cell = dict[tuple[int, int], tuple[int, str]]
#: Rows of a part at most: what one cell covers when a task hands it on.
PART = 1 << 14


def _best(pairs) -> Cell:
    cell: Cell = {}
    for key, found in pairs:
        if key not in cell or found < cell[key]:
            cell[key] = found
    return cell


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans."""
    return _best(((p, q), (c + d, x + y)) for (p, r), (c, x) in left.items() for (s, q), (d, y) in right.items() if r == s)


def _closure() -> Cell:
    """Cells of an empty span: what insertions alone lead to."""
    one = {(p, q): (INSERT, "I") for (p, role), q in STEPS.items() if role != "s"}
    cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        cell = _best([*cell.items(), *combined(cell, one).items()])
    return cell


EMPTY = _closure()


@lru_cache(maxsize=1 << 16)
def _short(codes: str) -> Cell:
    """cell() of a short span; what was parsed once isn't parsed again."""
    if len(codes) == 1:
        role, state = codes.lower(), codes.isupper()  # upper case: truncated
        if role in "d":
            edits = {(p, p): (DELETE, "D") for p in range(4)}
        else:
            extra = TRUNCATED if state else 0
            moves = [((p, q), (extra, "K")) for (p, r), q in STEPS.items() if r == role]
            moves += [((p, q), (REROLE + extra, "R")) for (p, r), q in STEPS.items() if r in "ua"]
            edits = _best([*moves, *(((p, p), (DELETE, "D")) for p in range(4))])
        return combined(combined(EMPTY, edits), EMPTY)
    half = 1 << (len(codes) - 1).bit_length() - 1
    return combined(_short(codes[:half]), _short(codes[half:]))


def cell(codes: str) -> Cell:
    """The cell of rows given by a letter each: s, u, a or x for another role, upper case if truncated; d if the row must go."""
    if not codes:
        return EMPTY
    cells = [_short(codes[i : i + 8]) for i in range(0, len(codes), 8)]
    return joined(cells)


def joined(cells: list[Cell]) -> Cell:
    """The cell of adjacent spans in order: neighbours by twos, until one is left."""
    while len(cells) > 1:
        cells = [combined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def repair(parsed: Cell) -> tuple[int, str]:
    """Cost and audit of the cheapest edits that give a sound conversation."""
    return min(parsed[0, q] for q in FINAL if (0, q) in parsed)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows after damage by crc32(conv_id:turn) % 20: 0 drops, 1 empties, 2 takes `[.!?]` out, 3 repeats, 4 makes it the user's. Null roles and texts become a space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20).alias("how")).filter("how <> 0")
    fixed = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    x = x.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), fixed.alias("text"), "how")
    return x.withColumn("copy", F.explode(F.expr("sequence(1, if(how = 3, 2, 1))"))).drop("copy", "how")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def is_truncated(text: Column) -> Column:
    """The last character that isn't white space doesn't end a sentence."""
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


_NAMES = ["conv_id", "part", "codes", "cells", "blank", "duplicate", "truncated", "illegal", "first", "last"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])), *[pa.int64()] * 4, pa.string(), pa.string()]
_PARTS = "conv_id long, part long, codes long, cells array<struct<p:int,q:int,cost:bigint,audit:string>>, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _listed(x: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in x.items()]


def _part(rows: list[tuple]) -> tuple:
    """Adjacent rows (conv_id, file, pos, initial, fault) as a row of _PARTS, but for the cell."""
    codes = "".join("d" if fault in ("b", "d") else c.upper() if fault == "t" else c for *_, initial, fault in rows for c in [initial if initial in ("s", "u", "a") else "x"])
    initials, faults = [r[3] for r in rows], [r[4] for r in rows]
    illegal = sum(x + y not in SOUND for x, y in zip(initials, initials[1:], strict=False))
    return rows[0][0], rows[0][2], len(rows), cell(codes), faults.count("b"), faults.count("d"), faults.count("t"), illegal, initials[0], initials[-1]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, file, pos, initial, fault), in order, to a cell for each part of a conversation, PART rows at most."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [[_listed(x[3]) if k == 3 else x[k] for x in out] for k in range(len(_NAMES))]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _KINDS, strict=True)], _NAMES)

    for _, same in groupby(rows, lambda r: (r[0], r[1])):
        part: list[tuple] = []
        for r in same:
            part.append(r)
            if len(part) == PART:
                out.append(_part(part))
                part = []
        out += [_part(part)] if part else []
        if len(out) >= 1024 or len(out) and out[-1][2] >= 1024:
            yield flush()
            out = []
    if out:
        yield flush()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations, ordered, to one row each: the counts, cost and audit."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    kinds = [pa.int64(), *[pa.int64()] * 5, pa.string()]
    for conv, same in groupby(rows, lambda r: r[0]):
        spans: list[tuple[int, Cell]] = []  # a carry of spans, each at least as long as what follows, so that cells are joined by like length
        sums, last = [0, 0, 0, 0], None
        for r in same:
            sums = [x + y for x, y in zip(sums, r[4:8], strict=True)]
            sums[3] += last is not None and last + r[8] not in SOUND
            last = r[9]
            size, one = r[2], {(x["p"], x["q"]): (x["cost"], x["audit"]) for x in r[3]}
            while spans and spans[-1][0] <= size:
                before, left = spans.pop()
                size, one = size + before, combined(left, one)
            spans.append((size, one))
        cost, audit = repair(joined([x for _, x in spans]))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv, *sums, cost, audit), kinds, strict=True)], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _digest(audit: str, rows: Iterator[tuple]) -> str:
    """SHA-256 of the repaired rows, of rows (.., .., role, text) in order, text by text. A sound conversation of an odd length begins with the system's row."""
    roles = ("user", "assistant") if (len(audit) - audit.count("D")) % 2 == 0 else ("assistant", "user")
    sha, place = hashlib.sha256(), 0
    for edit in audit:
        r = next(rows) if edit != "I" else None
        if edit != "D":
            line = f"{r[2]}:{r[3]}" if edit == "K" else f"{roles[place % 2]}:{r[3] if r else ''}"
            sha.update(("\n" * (place > 0) + line).encode())
            place += 1
    return sha.hexdigest()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order, each conversation after a row with its audit, to the repaired rows' SHA-256."""
    rows = (r for batch in batches for i in range(0, batch.num_rows, 256) for r in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True))
    for conv, same in groupby(rows, lambda r: r[0]):
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([_digest(next(same)[4], same)])], ["conv_id", "repaired_sha256"])


_CLOSED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OPEN = "conv_id long, turn long, role string, text string, initial string, is_blank boolean, is_cut boolean, pos long, file long"
_SPLIT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("initial", pa.string()), ("is_blank", pa.bool_()), ("is_cut", pa.bool_()), ("pos", pa.int64()), ("file", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _whole(rows: list[tuple]) -> tuple:
    """What repaired() says of a conversation whose rows are all here, in order."""
    seen, faulty = set(), []
    for r in rows:
        faulty.append((r[0], 0, 0, r[4], "b" if r[5] else "d" if (r[2], r[3]) in seen else "t" if r[6] else ""))
        seen.add((r[2], r[3]))
    part = _part(faulty)
    turns = {r[1] for r in rows} - {None}
    cost, audit = repair(part[3])
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *part[4:8], cost, audit, _digest(audit, iter(rows))


def _split(held: int):
    """Rows in order: conversations that lie wholly within the task and have at most `held` rows become one row each; the others' rows go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for i in range(0, batch.num_rows, 256) for r in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True))
        out: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SPLIT, strict=True)], schema=_SPLIT)
                out.clear()

        before: list[tuple] = []  # a conversation that isn't the task's last if another one follows
        for k, (_, same) in enumerate(groupby(rows, lambda r: r[0])):
            if before:
                out.append((before[0][0], *[None] * 8, *_whole(before)))
            before, goes_on = [], k == 0
            for r in same:
                before.append(r)
                if goes_on or len(before) > held:
                    goes_on = True
                    out += [(*x, *[None] * 8) for x in before]
                    before = []
                if len(out) >= 256:
                    yield from flush()
        out += [(*x, *[None] * 8) for x in before]
        yield from flush()

    return run


def repaired(rows: DataFrame, held: int = PART) -> DataFrame:
    """rows (conv_id, turn, role, text) to a row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (nulls first); rows of one turn by role and text. A null role or text counts as one space; rows with a null
    conv_id are one conversation. A row's first fault counts: blank (nothing but white space), duplicate (its role and text came
    before), truncated. Blank and duplicate rows must go. A role with another or no initial than s, u or a can't be kept. Texts of
    any length are read one by one. Repeated rows are duplicates; extra columns are left out; no rows give no rows.

    Conversations of at most `held` rows that lie within one range are done where they lie. The others (those across the ends of
    ranges, and long ones) are parsed in parts by several tasks; only their audits and the hash of their texts, which has to read
    them in order, pass through one task each, row by row.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    x = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text")).repartitionByRange(*by).sortWithinPartitions(*by)
    x = x.withColumns({"initial": F.left("role", F.lit(1)), "is_blank": is_blank(F.col("text")), "is_cut": is_truncated(F.col("text")), "pos": F.monotonically_increasing_id(), "file": F.spark_partition_id().cast("long")})
    found = cut(x.mapInArrow(_split(held), f"{_OPEN}, {_CLOSED}"), "split")
    table = found.filter("pos is not null")
    same = F.coalesce(F.col("conv_id"), F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none")
    slim = cut(table.select("conv_id", *same, "turn", "file", "pos", "initial", "is_blank", "is_cut", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("h")), "slim")
    again = slim.groupBy("h", "c", "none").agg(F.min("pos").alias("seen"), F.count("*").alias("n")).filter("n > 1").drop("n")
    fault = F.when(F.col("is_blank"), "b").when(F.col("pos") > F.col("seen"), "d").when(F.col("is_cut"), "t").otherwise("")
    flags = slim.join(again, ["h", "c", "none"], "left").select("conv_id", "file", "pos", "initial", fault.alias("fault"))
    parts = flags.repartition("conv_id", "file").sortWithinPartitions("conv_id", "file", "pos").mapInArrow(_parsed, _PARTS)
    known = cut(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_together, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "known")
    none = F.lit(None).cast("string")
    lines = known.select("conv_id", F.lit(-1).cast("long").alias("pos"), none.alias("role"), none.alias("text"), "audit").unionByName(table.select("conv_id", "pos", "role", "text", none.alias("audit")))
    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_written, "conv_id long, repaired_sha256 string")
    turns = slim.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    rest = known.alias("k").join(hashes.alias("h"), F.col("k.conv_id").eqNullSafe(F.col("h.conv_id"))).join(turns.alias("t"), F.col("k.conv_id").eqNullSafe(F.col("t.conv_id")))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rest = rest.select("k.conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *names[2:])
    return found.filter("pos is null").select(names).unionByName(rest)


def checked(rows: DataFrame) -> DataFrame:
    """repaired() of the rows after damage, for every conv_id that rows has; one that lost all its rows has zeros, an empty audit and the hash of an empty text."""
    found = repaired(damaged(rows)).alias("f")
    every = rows.select(F.col("conv_id").cast("long")).distinct().alias("e")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = every.join(found, F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    return out.select("e.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
