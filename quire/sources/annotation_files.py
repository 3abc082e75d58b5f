"""Notes from files: the plain text format, JSON, CSV and notes.js, each to (doc_id, ord, para, quote, author, title, text, source, page, meta).

docs is always (doc_id, text), a file each. All but the plain format, whose lines are a small state machine, are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# The names under which a field may come, in tables and in JSON, the first that has a value counts.
NAMES = {
    "para": ("id", "para", "paragraph"), "quote": ("quote", "excerpt", "text_quote", "anchor"), "text": ("comment_text", "note", "text", "comment", "body"),
    "author": ("comment_author", "author", "by"), "title": ("comment_title", "title"), "source": ("comment_source", "source"), "page": ("page",),
}
JSON_NAMES = {
    "para": ("para", "id", "paragraph", "target"), "quote": ("quote", "excerpt", "match"), "text": ("text", "comment_text", "note", "body"),
    "author": ("author", "comment_author", "by"), "title": ("title", "comment_title", "heading"), "source": ("source", "comment_source"), "page": ("page",),
}
COLUMNS = ("para", "quote", "author", "title", "text", "source")
_FIELD = re.compile(r"(author|title|source|page|quote|para|id):\s*(.*)", re.IGNORECASE)
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _shaped(entries: DataFrame, entry: str = "entry", names: dict[str, tuple[str, ...]] = NAMES) -> DataFrame:
    """(doc_id, ord, entry map) to the common columns; unknown names go to meta, entries without text are left out. Names of tables are in any case."""
    low = F.transform_keys(entry, lambda k, _: F.lower(t.strip(k))) if names is NAMES else F.col(entry)
    rows = entries.withColumn("_e", low)
    pick = lambda some: F.coalesce(*[F.nullif(t.strip(F.try_element_at("_e", F.lit(n))), F.lit("")) for n in some], F.lit(""))
    known = [n for some in names.values() for n in some]
    out = rows.select("doc_id", "ord", *[pick(names[c]).alias(c) for c in COLUMNS], F.coalesce(pick(names["page"]).try_cast("int"), F.lit(0)).alias("page"), F.map_filter("_e", lambda k, _: ~k.isin(*known)).alias("meta"))
    return out.filter("text <> ''")


def from_json(docs: DataFrame) -> DataFrame:
    """A list of objects, or a map of paragraph ids to lists of them."""
    body = F.regexp_replace("text", r"^\ufeff?\s+", "")
    listed = docs.filter(body.startswith("[")).select("doc_id", F.posexplode(F.from_json("text", "array<map<string,string>>")).alias("ord", "entry"))
    mapped = docs.filter(body.startswith("{"))
    return _shaped(listed, names=JSON_NAMES).unionByName(_shaped(_by_paragraph(mapped.select("doc_id", F.col("text").alias("json"))), names=JSON_NAMES))


def json_errors(docs: DataFrame) -> DataFrame:
    """(doc_id, error) of files that from_json() reads nothing of: those that aren't JSON, and those that are neither a list of objects nor a map of paragraph ids."""
    body = F.regexp_replace("text", r"^\ufeff?\s+", "")
    listed = F.from_json("text", "array<map<string,string>>")
    mapped = F.from_json("text", "map<string,array<map<string,string>>>")
    error = F.when(F.try_parse_json("text").isNull(), "not valid JSON").when(~body.rlike(r"^[\[{]"), "neither a list of notes nor a map of paragraph ids")
    error = error.when(body.startswith("[") & (listed.isNull() | F.exists(listed, lambda x: x.isNull())), "a note is not an object").when(body.startswith("{") & mapped.isNull(), "not a map of paragraph ids to notes")
    return docs.select("doc_id", error.alias("error")).filter("error is not null")


def _by_paragraph(docs: DataFrame) -> DataFrame:
    """(doc_id, json) of {id: [notes]} to (doc_id, ord, entry), in order."""
    ids = F.map_entries(F.from_json("json", "map<string,array<map<string,string>>>"))
    rows = docs.select("doc_id", F.posexplode(ids).alias("_i", "x")).select("doc_id", "_i", F.col("x.key").alias("para"), F.posexplode("x.value").alias("_j", "entry"))
    entry = F.map_concat(F.map_filter("entry", lambda k, _: F.lower(k) != "para"), F.create_map(F.lit("para"), F.col("para")))
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_i", "_j")) - 1).alias("ord"), entry.alias("entry"))


def from_notes_js(docs: DataFrame) -> DataFrame:
    """window.NOTES = {...}, then addNote("para", "author", "text", "title", "source") calls, numbered on from the last of the map."""
    json = F.regexp_extract("text", r"(?s)window\.NOTES\s*=\s*(\{.*)", 1)
    mapped = _by_paragraph(docs.select("doc_id", json.alias("json")).filter("json <> ''"))
    first = _shaped(mapped, names=JSON_NAMES)
    last = mapped.groupBy("doc_id").agg((F.max("ord") + 1).alias("_from"))
    calls = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"\baddNote\s*\(\s*({_STRING}(?:\s*,\s*{_STRING})*)"), F.lit(1))).alias("_i", "call"))
    args = calls.join(last, "doc_id", "left").withColumn("a", F.from_json(F.concat(F.lit("["), "call", F.lit("]")), "array<string>"))
    get = lambda i: F.coalesce(F.get("a", F.lit(i)), F.lit(""))
    entry = F.create_map(*[x for i, n in enumerate(("para", "author", "text", "title", "source")) for x in (F.lit(n), get(i))])
    return first.unionByName(_shaped(args.select("doc_id", (F.col("_i") + F.coalesce("_from", F.lit(0))).alias("ord"), entry.alias("entry"))))


def from_notes_lenient(docs: DataFrame) -> DataFrame:
    """Notes files as far as they can be read: as from_notes_js(), and of files that it finds no notes in, what stands between the first and the last brace.

    That is read as JSON, paragraph ids to a note or a list of notes; entries that are no objects or have no text are left out.
    A null text (a file that isn't there) has no notes. notes_errors() tells the files of which nothing can be read.
    """
    strict, lost = _parted(docs)
    entries = F.map_entries(F.expr("try_variant_get(body, '$', 'map<string,variant>')"))
    pairs = lost.select("doc_id", F.posexplode(entries).alias("_i", "x")).select("doc_id", "_i", F.col("x.key").alias("para"), F.col("x.value").alias("v"))
    listed = pairs.withColumn("list", F.when(F.expr("schema_of_variant(v) like 'ARRAY%'"), F.expr("try_variant_get(v, '$', 'array<variant>')")).otherwise(F.array("v")))
    notes = listed.select("doc_id", "_i", "para", F.posexplode("list").alias("_j", "note")).filter(F.expr("schema_of_variant(note) like 'OBJECT%'"))
    field = lambda n: F.coalesce(F.expr(f"try_variant_get(note, '$.{n}', 'string')"), F.lit(""))
    entry = F.create_map(F.lit("para"), F.col("para"), *[x for n in ("author", "title", "text", "source") for x in (F.lit(n), field(n))])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_i", "_j")) - 1
    return from_notes_js(strict).unionByName(_shaped(notes.select("doc_id", number.alias("ord"), entry.alias("entry")), names=JSON_NAMES))


def notes_errors(docs: DataFrame) -> DataFrame:
    """(doc_id, error) of notes files of which from_notes_lenient() can read nothing."""
    _, lost = _parted(docs)
    error = F.when(F.col("json") == "", "does not look like a notes file").when(F.col("body").isNull(), "could not be read as JSON").when(~F.expr("schema_of_variant(body) like 'OBJECT%'"), "not a map of paragraph ids to notes")
    return lost.select("doc_id", error.alias("error")).filter("error is not null")


def _parted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs that from_notes_js() can read, and the others with json, from the first to the last brace, and body, the same parsed."""
    there = docs.filter("text is not null")
    mapped = F.from_json(F.regexp_extract("text", r"(?s)window\.NOTES\s*=\s*(\{.*)", 1), "map<string,array<map<string,string>>>")
    rows = there.withColumn("_strict", F.coalesce(F.size(mapped) >= 0, F.lit(False)) & mapped.isNotNull() | F.col("text").rlike(r"\baddNote\s*\(\s*\""))
    json = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    lost = rows.filter(~F.col("_strict")).select("doc_id", json.alias("json"))
    plain = F.regexp_replace("json", r"[\x00-\x1F]+", " ")  # for strings with raw line breaks
    return rows.filter("_strict").drop("_strict"), lost.withColumn("body", F.coalesce(F.try_parse_json("json"), F.try_parse_json(plain)))


def from_csv(docs: DataFrame, separator: str = ",") -> DataFrame:
    """Rows under a header line; para counts only where there is no quote. Quoted cells may hold separators, line breaks and doubled quotes."""
    sep = re.escape(separator)
    quoted = '"[^"]*+(?:""[^"]*+)*+"'
    any_cell = rf'(?:{quoted}[^{sep}\r\n]*+|(?!")[^{sep}\r\n]*+)'
    record = rf"{any_cell}(?:{sep}{any_cell})*+(?:\r?\n|\r|\z)"
    text = F.regexp_replace("text", "^\ufeff", "")
    lines = docs.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(record), F.lit(0))).alias("ord", "line")).withColumn("line", F.regexp_replace("line", r"[\r\n]+\z", "")).filter("line <> ''")
    cell = rf'(?:^|{sep})(?:"([^"]*+(?:""[^"]*+)*+)"[^{sep}]*+|([^{sep}]*+))'
    cells = F.zip_with(F.regexp_extract_all("line", F.lit(cell), F.lit(1)), F.regexp_extract_all("line", F.lit(cell), F.lit(2)), lambda a, b: F.when(a != "", F.replace(a, F.lit('""'), F.lit('"'))).otherwise(b))
    rows = lines.withColumn("cells", cells)
    heads = rows.groupBy("doc_id").agg(F.min_by("cells", "ord").alias("names"), F.min("ord").alias("_head"))
    both = rows.join(heads.select("doc_id", "_head", F.transform("names", lambda c: F.lower(t.strip(c))).alias("names")), "doc_id").filter(F.col("ord") > F.col("_head"))
    n = F.least(F.size("names"), F.size("cells"))
    out = _shaped(both.select("doc_id", "ord", F.map_from_arrays(F.slice("names", F.lit(1), n), F.slice("cells", F.lit(1), n)).alias("entry")))
    return out.withColumn("para", F.when(F.col("quote") != "", "").otherwise(F.col("para")))


def render_csv(notes: DataFrame, separator: str = ",") -> DataFrame:
    """(doc_id, text): notes (doc_id, para, para_ord, idx and fields) in order, under the header id, comment_author, comment_title, comment_text, comment_source; all cells quoted."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(t.plain(c), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(separator, *[cell(c) for c in ("para", "author", "title", "text", "source")])
    head = separator.join(("id", "comment_author", "comment_title", "comment_text", "comment_source"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_ord", "idx", line.alias("l")))), lambda x: x["l"]), "\r\n")
    return notes.groupBy("doc_id").agg(F.concat(F.lit(head + "\r\n"), rows, F.lit("\r\n")).alias("text"))


def _blocks(text: str) -> Iterator[dict]:
    note: dict | None = None
    fence: list[str] | None = None
    for raw in text.replace("\r\n", "\n").split("\n"):
        line = raw.strip()
        is_fence = len(line) >= 3 and not line.strip('"')
        if fence is not None:
            if is_fence:
                note["quote"], fence = " ".join(fence), None
            elif line:
                fence.append(line)
            continue
        if is_fence or re.fullmatch(r"@[\w.:-]+", line):
            if note:
                yield note
            note = {"body": [], "para": "" if is_fence else line[1:]}
            fence = [] if is_fence else None
        elif note is not None and line:
            field = None if note["body"] or line.startswith("\u200b") else _FIELD.fullmatch(line)
            if field:
                note[{"id": "para"}.get(field[1].lower(), field[1].lower())] = field[2].strip()
            else:
                note["body"].append(line.lstrip("\u200b"))
    if note:
        yield note


def from_text(docs: DataFrame) -> DataFrame:
    """@id lines or quotes fenced by three quotation marks, field lines, then the note. A line after a zero-width space is never a field."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc, k, *(n.get(c, "") for c in ("para", "quote", "author", "title")), " ".join(n["body"]), n.get("source", ""), int(n.get("page", "")) if n.get("page", "").isdigit() else 0)
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True) for k, n in enumerate(_blocks(text or ""), 1)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "para", "quote", "author", "title", "text", "source", "page"])

    found = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {doc_id}, ord int, para string, quote string, author string, title string, text string, source string, page int")
    return found.filter("text <> ''").withColumn("meta", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def loaded(files: DataFrame) -> DataFrame:
    """files (doc_id, name, text), each read by its name's ending and first character: [ is always JSON."""
    first = F.substring(F.regexp_replace("text", r"^\ufeff?\s*", ""), 1, 1)
    end = F.lower(F.regexp_extract("name", r"\.([A-Za-z]+)$", 1))
    kind = F.when(first == "[", "json").when(end.isin("csv", "tsv", "js"), end).when(first == "{", "json").otherwise("text")
    rows = files.withColumn("kind", kind)
    of = lambda k: rows.filter(F.col("kind") == k).select("doc_id", "text")
    out = from_json(of("json"))
    for part in (from_csv(of("csv")), from_csv(of("tsv"), "\t"), from_notes_js(of("js")), from_text(of("text"))):
        out = out.unionByName(part)
    return out


def render_text(notes: DataFrame) -> DataFrame:
    """(doc_id, text): the plain format of notes (doc_id, para, para_ord, idx and fields); a text that looks like a field is guarded by a zero-width space."""
    looks = t.plain("text").rlike(r"(?i)^(?:author|title|source|page|quote|para|id):")
    fields = [F.when(t.plain(f) != "", F.concat(F.lit(f"{f.capitalize()}: "), f)) for f in ("author", "title", "source")]
    body = F.concat(F.when(looks, "\u200b").otherwise(""), "text")
    block = F.concat_ws("\n", F.concat(F.lit("@"), "para"), *fields, body, F.lit(""))
    return notes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_ord", "idx", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def render_json(notes: DataFrame, paras: DataFrame) -> DataFrame:
    """(doc_id, text): a JSON list of notes (doc_id, para, para_ord, idx and fields) in order, each with the label and text of its paragraph in paras (doc_id, id, label, text), empty where it has none."""
    known = paras.select("doc_id", F.col("id").alias("para"), F.col("label").alias("label"), F.col("text").alias("paragraph"))
    rows = notes.select("doc_id", "para", "para_ord", "idx", *[F.nullif(t.plain(f), F.lit("")).alias(f) for f in ("author", "title", "text", "source")]).join(known, ["doc_id", "para"], "left")
    note = F.to_json(F.struct("author", "title", "text", "source", "para", t.plain("label").alias("label"), t.plain("paragraph").alias("paragraph")))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("[\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_ord", "idx", note.alias("j")))), lambda x: x["j"]), ",\n"), F.lit("\n]\n")).alias("text"))


def render_notes_js(notes: DataFrame) -> DataFrame:
    """(doc_id, text): window.NOTES = {...}, indented by two blanks, and the event that tells the page; notes (doc_id, para, para_ord, idx and fields) in order, empty fields left out."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    fields = [F.when(t.plain(f) != "", F.concat(F.lit(f'      "{f}": '), quoted(F.col(f)))) for f in ("author", "title", "text", "source")]
    note = F.concat(F.lit("    {\n"), F.concat_ws(",\n", *fields), F.lit("\n    }"))
    listed = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("_v")))), lambda x: x["_v"]), ",\n")
    lists = notes.groupBy("doc_id", "para", "para_ord").agg(listed("idx", note).alias("list"))
    line = F.concat(F.lit("  "), quoted(F.col("para")), F.lit(": [\n"), F.col("list"), F.lit("\n  ]"))
    return lists.groupBy("doc_id").agg(F.concat(F.lit("window.NOTES = {\n"), listed("para_ord", line), F.lit("\n};\nwindow.dispatchEvent(new Event('notes:ready'));\n")).alias("text"))
