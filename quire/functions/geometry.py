"""Boxes as struct<x0, y0, x1, y1>: the algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def box(x0: str | Column, y0: str | Column, x1: str | Column, y1: str | Column) -> Column:
    return F.struct(*[col(v).cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def area(a: Column) -> Column:
    return F.greatest(a["x1"] - a["x0"], F.lit(0.0)) * F.greatest(a["y1"] - a["y0"], F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def intersection(a: Column, b: Column) -> Column:
    """The common box; null if there is none."""
    c = box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))
    return F.when((c["x1"] > c["x0"]) & (c["y1"] > c["y0"]), c)


def overlap_area(a: Column, b: Column) -> Column:
    return F.coalesce(area(intersection(a, b)), F.lit(0.0))


def overlap_share(a: Column, b: Column) -> Column:
    """Of a's own area."""
    return F.when(area(a) > 0, overlap_area(a, b) / area(a)).otherwise(0.0)


def gap(a: Column, b: Column, axis: str) -> Column:
    """Distance along x or y; below zero where they overlap."""
    low, high = f"{axis}0", f"{axis}1"
    return F.when(b[low] >= a[high], b[low] - a[high]).when(a[low] >= b[high], a[low] - b[high]).otherwise(-(F.least(a[high], b[high]) - F.greatest(a[low], b[low])))


def contains_point(a: Column, x: Column, y: Column) -> Column:
    return x.between(a["x0"], a["x1"]) & y.between(a["y0"], a["y1"])


def contains(a: Column, b: Column) -> Column:
    return (b["x0"] >= a["x0"]) & (b["y0"] >= a["y0"]) & (b["x1"] <= a["x1"]) & (b["y1"] <= a["y1"])


def grown(a: Column, dx: float, dy: float | None = None) -> Column:
    dy = dx if dy is None else dy
    return box(a["x0"] - dx, a["y0"] - dy, a["x1"] + dx, a["y1"] + dy)


def flipped(a: Column, height: Column) -> Column:
    """From user space (y up) to page space (y down)."""
    return box(a["x0"], height - a["y1"], a["x1"], height - a["y0"])


def to_display(a: Column, width: Column, height: Column, rotation: Column) -> Column:
    """From page space into the space that a rotation by 0, 90, 180 or 270 degrees shows."""
    turn = F.pmod(rotation, F.lit(360))
    return (
        F.when(turn == 90, box(height - a["y1"], a["x0"], height - a["y0"], a["x1"]))
        .when(turn == 180, box(width - a["x1"], height - a["y1"], width - a["x0"], height - a["y0"]))
        .when(turn == 270, box(a["y0"], width - a["x1"], a["y1"], width - a["x0"]))
        .otherwise(a)
    )


def from_display(a: Column, width: Column, height: Column, rotation: Column) -> Column:
    turn = F.pmod(rotation, F.lit(360))
    return (
        F.when(turn == 90, box(a["y0"], height - a["x1"], a["y1"], height - a["x0"]))
        .when(turn == 180, box(width - a["x1"], height - a["y1"], width - a["x0"], height - a["y0"]))
        .when(turn == 270, box(width - a["y1"], a["x0"], width - a["y0"], a["x1"]))
        .otherwise(a)
    )


def display_size(width: Column, height: Column, rotation: Column) -> Column:
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))
