"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import cut


def _star(links: DataFrame, name: str) -> DataFrame:
    """links (u, v): each v of a u, and u, with the least of them, as (a, b)."""
    least = cut(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")  # as a table, so that hot nodes' joins are broadcast or split
    return links.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long; null ends and loops are left out) to (node, component): the least node that links reach from each linked node.

    Rounds repeat until nothing changes: about the logarithm of the longest chain. Each writes its links to the shared folder.
    """
    ordered = lambda x: x.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now = cut(ordered(links.filter("a is not null and b is not null")), "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(ordered(_star(both, "large").filter("a > b")), "large")
        small = _star(large, "small").union(large.groupBy("u").agg(F.min("v").alias("m")).select("u", "m"))
        now = cut(ordered(small), "small")
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        loose = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
        if loose.isEmpty():  # all are stars: each node has one link, to a node that has none upwards
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, as (node, least node of its tree)."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in list(up) if top(x) != x]
