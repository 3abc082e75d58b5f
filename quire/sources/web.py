"""Published pages: what they say about themselves, their paragraphs and headings; and pages rendered from blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


#: What stands between texts that are decoded together.
_BETWEEN = "\x1e"


def title(html: str | Column, closed: bool = False) -> Column:
    """The title element, or else the page-title heading; closed: character references cut off before their semicolon stay as they are."""
    html = t.col(html)
    found = F.nullif(t.without_tags(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), closed), F.lit(""))
    return F.coalesce(found, t.without_tags(F.regexp_extract(html, r"""(?is)<h1[^>]*id=["']page-title["'][^>]*>(.*?)</h1>""", 1), closed))


def description(html: str | Column) -> Column:
    html = t.col(html)
    one = F.regexp_extract(html, r"""(?i)<meta[^>]+name=["']description["'][^>]*content=["']([^"']*)["']""", 1)
    return F.when(one != "", one).otherwise(F.regexp_extract(html, r"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]*name=["']description["']""", 1))


def notes_file(html: str | Column) -> Column:
    """The first script whose address speaks of notes, without its query."""
    return F.regexp_extract(t.col(html), r"""(?i)<script[^>]+src=["']([^"'?]*notes[^"'?]*)""", 1)


def paragraphs(pages: DataFrame, pattern: str = r"(?s)<p[^>]*>(.*?)</p>", closed: bool = False) -> DataFrame:
    """pages (page_id, html) to (page_id, idx, text): visible text of each p element that has any; closed as in title()."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("idx", "body"))
    return rows.select("page_id", "idx", t.without_tags("body", closed).alias("text")).filter("text <> ''")


def identified(pages: DataFrame) -> DataFrame:
    """pages (doc_id, html) to (doc_id, ord, id, text): paragraphs inside a div with an id, and any more attributes."""
    pattern = r'(?s)<div id="([^"]+)"[^>]*>.*?<p>(.*?)</p>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("id"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("body"))
    return pages.select("doc_id", F.posexplode(both).alias("ord", "x")).select("doc_id", "ord", F.col("x.id").alias("id"), t.squeezed(t.unescaped(F.regexp_replace("x.body", "<[^>]+>", ""))).alias("text"))


def headings(html: str | Column) -> Column:
    """The texts of h3 elements, decoded together."""
    found = F.transform(F.regexp_extract_all(t.col(html), F.lit(r"(?s)<h3[^>]*>(.*?)</h3>"), F.lit(1)), lambda x: F.translate(F.regexp_replace(x, "<[^>]+>", ""), _BETWEEN, ""))
    return F.when(F.size(found) > 0, F.transform(F.split(t.unescaped(F.array_join(found, _BETWEEN)), _BETWEEN), t.squeezed)).otherwise(found)


def rendered_body(blocks: DataFrame) -> DataFrame:
    """(doc_id, body): blocks (doc_id, ord, kind, level, id, label, text) as HTML in order."""
    head = F.concat(F.lit('<h3 data-level="'), F.coalesce(F.nullif("level", F.lit(0)), F.lit(2)).cast("string"), F.lit('"><strong>'), t.escaped("text"), F.lit("</strong></h3>\n"))
    para = F.concat(F.lit('<div id="'), t.escaped("id", True), F.lit('" data-label="'), t.escaped("label"), F.lit('"><button data-para="'), t.escaped("id", True), F.lit('">'), t.escaped("label"), F.lit("</button><p>"), t.escaped("text"), F.lit("</p></div>\n"))
    line = F.when(F.col("kind") == "heading", head).otherwise(para)
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "").alias("body"))


def rendered_pages(blocks: DataFrame, notes_js: DataFrame) -> DataFrame:
    """(doc_id, html, notes): a whole page per document, with its notes file named by the hash of its contents."""
    both = rendered_body(blocks).join(notes_js.withColumnRenamed("text", "notes"), "doc_id", "left").withColumn("notes", F.coalesce("notes", F.lit("window.NOTES = {};\n")))
    script = F.concat(F.lit('<script src="notes.js?v='), t.short_hash("notes"), F.lit('"></script>'))
    return both.select("doc_id", F.concat(F.lit("<!DOCTYPE html>\n<html><body>\n"), "body", script, F.lit("\n</body></html>\n")).alias("html"), "notes")


def cards(pages: DataFrame) -> DataFrame:
    """(doc_id, ord, title, subtitle, description, href) of {title: '...', subtitle: '...', desc: '...', href: '...'} entries in a page's script."""
    value = lambda name: rf"{name}:\s*'([^'\\]*+(?:\\.[^'\\]*+)*+)'\s*,?\s*"
    pattern = r"(?s)\{\s*" + value("title") + value("subtitle") + value("desc") + value("href") + r"\}"
    groups = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("title", "subtitle", "description", "href"), 1)])
    return pages.select("doc_id", F.posexplode(groups).alias("ord", "x")).select("doc_id", "ord", "x.*")


def found_cards(cards: DataFrame, query: str) -> DataFrame:
    """cards whose title, subtitle and description hold the query, in any case; all for a blank one."""
    words = query.strip().lower()
    return cards.filter(F.lower(F.concat("title", "subtitle", "description")).contains(words)) if words else cards


def card_of(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """pages (page) with the title, subtitle and description of the first card (ord) whose address ends in the page's name, with or without its ending."""
    stem = lambda x: F.regexp_replace(F.regexp_extract(x, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    named = cards.withColumn("_stem", stem(F.regexp_replace("href", r"\?.*", ""))).filter("_stem <> ''")
    first = named.groupBy("_stem").agg(F.min_by(F.struct("title", "subtitle", "description"), "ord").alias("_card"))
    return pages.withColumn("_stem", stem(F.col("page"))).join(first, "_stem", "left").select(*pages.columns, "_card.*")


def label_snippet(label: str | Column, text: str | Column, width: int = 52) -> Column:
    """A paragraph's label, if it has one of its own, and the start of its text, cut between words."""
    one = t.squeezed(t.plain(text))
    cut = F.when(F.length(one) > width, F.concat(F.regexp_replace(F.left(one, F.lit(width)), r"\s\S*$", ""), F.lit("…"))).otherwise(one)
    own = t.strip(t.plain(label))
    return F.concat(F.when((own != "") & (own != "¶"), F.concat(own, F.lit(" · "))).otherwise(""), cut)
