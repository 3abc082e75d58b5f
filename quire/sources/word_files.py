"""Word files: paragraphs and comments of .docx packages read by Spark as binary files, a package to a row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read(spark, path: str) -> DataFrame:
    """(doc_id, content) of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def _part(package: bytes, name: str):
    try:
        with zipfile.ZipFile(io.BytesIO(package)) as z:
            return ElementTree.fromstring(z.read(name))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return None


def _levels(styles) -> dict[str, int]:
    found = {}
    for style in styles.iter(f"{W}style") if styles is not None else ():
        name = style.find(f"{W}name")
        if m := re.fullmatch(r"(?:heading\s*([1-9])|(title))", (name.get(f"{W}val") if name is not None else "").lower()):
            found[style.get(f"{W}styleId")] = min(4, int(m[1])) if m[1] else 1
    return found


def _pieces(paragraph) -> list[str]:
    """A paragraph's text, cut at line breaks; deleted text is none of it."""
    out = [""]
    for e in paragraph.iter():
        if e.tag == f"{W}t":
            out[-1] += e.text or ""
        elif e.tag == f"{W}tab":
            out[-1] += " "
        elif e.tag in (f"{W}br", f"{W}cr"):
            out.append("")
    return out


def paragraphs(files: DataFrame) -> DataFrame:
    """(doc_id, ord, text, level): what each file's body holds in order; level from heading styles, 0 for none. A file that is no package has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                body, levels, n = _part(content, "word/document.xml"), _levels(_part(content, "word/styles.xml")), 0
                for p in body.iter(f"{W}p") if body is not None else ():
                    style = p.find(f"{W}pPr/{W}pStyle")
                    name = style.get(f"{W}val") if style is not None else ""
                    level = levels.get(name, int(m[1]) if (m := re.fullmatch(r"Heading([1-4])", name)) else 0)
                    for piece in _pieces(p):
                        rows.append((doc, n, piece, level))
                        n += 1
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "text", "level"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, ord int, text string, level int")


def comments(files: DataFrame) -> DataFrame:
    """(doc_id, comment_id, author, date, text, quote, position): comments that aren't empty, the text that each is anchored on, and where, from 0 to 1 (-1 for no anchor)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                notes, body = _part(content, "word/comments.xml"), _part(content, "word/document.xml")
                open_: dict[str, list[str]] = {}
                quotes: dict[str, str] = {}
                at: dict[str, int] = {}
                n = 0
                for e in body.iter() if body is not None else ():
                    mark = e.get(f"{W}id")
                    if e.tag == f"{W}p":
                        n += 1
                        for parts in open_.values():
                            parts.append(" ")
                    elif e.tag == f"{W}commentRangeStart":
                        open_[mark], at[mark] = [], n
                    elif e.tag == f"{W}commentRangeEnd" and mark in open_:
                        quotes[mark] = " ".join("".join(open_.pop(mark)).split())
                    elif e.tag == f"{W}t":
                        for parts in open_.values():
                            parts.append(e.text or "")
                for c in notes.iter(f"{W}comment") if notes is not None else ():
                    mark = c.get(f"{W}id")
                    if text := "\n".join(" ".join("".join(_pieces(p)).split()) for p in c.iter(f"{W}p")).strip():
                        rows.append((doc, mark, c.get(f"{W}author") or "", c.get(f"{W}date") or "", text, quotes.get(mark, ""), at[mark] / n if mark in at and n else -1.0))
            yield pd.DataFrame(rows, columns=["doc_id", "comment_id", "author", "date", "text", "quote", "position"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, comment_id string, author string, date string, text string, quote string, position double")
