"""Spans of a line, (text, font, size, flags): what their fonts say, and colours as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

# Bits of a font's flags.
ITALIC, SERIF, MONOSPACE, BOLD = 2, 4, 8, 16


def _named(font: str | Column, *words: str) -> Column:
    return F.lower(F.coalesce(col(font), F.lit(""))).rlike("|".join(words))


def _flagged(flags: str | Column, bit: int) -> Column:
    return F.coalesce(col(flags), F.lit(0)).bitwiseAND(bit) > 0


def is_bold(font: str | Column, flags: str | Column) -> Column:
    return _flagged(flags, BOLD) | _named(font, "bold")


def is_italic(font: str | Column, flags: str | Column) -> Column:
    return _flagged(flags, ITALIC) | _named(font, "italic", "oblique")


def is_monospace(font: str | Column, flags: str | Column) -> Column:
    return _flagged(flags, MONOSPACE) | _named(font, "mono", "courier")


def is_serif(font: str | Column, flags: str | Column) -> Column:
    return _named(font, "times", "serif", "georgia", "garamond", "roman") | (_flagged(flags, SERIF) & ~is_monospace(font, flags))


def family_flags(family: str | Column) -> Column:
    """Flags that a family's name speaks of."""
    bit = lambda value, *words: F.when(_named(family, *words), value).otherwise(0)
    return bit(BOLD, "bold") + bit(ITALIC, "italic", "oblique") + bit(MONOSPACE, "mono", "courier") + bit(SERIF, "times", "serif", "roman")


def colour_of_number(value: str | Column) -> Column:
    """#rrggbb of a whole number."""
    return F.when(col(value).isNotNull(), F.concat(F.lit("#"), F.lower(F.lpad(F.hex(col(value)), 6, "0")))).otherwise("")


def colour_of_text(value: str | Column) -> Column:
    """#rrggbb of six hex digits, with or without the mark; else empty."""
    return F.coalesce(F.concat(F.lit("#"), F.nullif(F.lower(F.regexp_extract(F.trim(col(value)), r"^#?([0-9A-Fa-f]{6})$", 1)), F.lit(""))), F.lit(""))


def colour_of_shares(value: str | Column) -> Column:
    """#rrggbb of shares from 0 to 1: one is a grey, three a colour, of four the last is left out; else empty."""
    part = lambda x: F.lower(F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.bround(x * 255, 0).cast("int")))), 2, "0"))
    shares = col(value)
    three = F.concat(F.lit("#"), *[part(F.get(shares, F.lit(i))) for i in range(3)])
    return F.coalesce(F.when(F.size(shares) == 1, F.concat(F.lit("#"), F.repeat(part(F.get(shares, F.lit(0))), F.lit(3)))).when(F.size(shares).isin(3, 4), three), F.lit(""))


def lines_of_spans(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, text, size, bold_share, italic_share): spans joined in order; the size, to a tenth, of most characters (of equal ones the first seen), and the shares of characters in bold and italic spans."""
    n = F.length("text")
    rows = spans.withColumns({"_size": F.bround("size", 1), "_bold": is_bold("font", "flags"), "_italic": is_italic("font", "flags")})
    sizes = rows.groupBy(*keys, "_size").agg(F.sum(F.greatest(F.lit(1), n)).alias("_w"), F.min(order).alias("_first"), F.sum(n).alias("_n"), *[F.sum(F.when(F.col(c), n).otherwise(0)).alias(c) for c in ("_bold", "_italic")], F.collect_list(F.struct(order, "text")).alias("_parts"))
    share = lambda c: F.sum(c) / F.greatest(F.lit(1), F.sum("_n"))
    text = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("_parts"))), lambda x: x["text"]), "")
    return sizes.groupBy(*keys).agg(text.alias("text"), F.max_by("_size", F.struct("_w", -F.col("_first"))).alias("size"), share("_bold").alias("bold_share"), share("_italic").alias("italic_share"))
