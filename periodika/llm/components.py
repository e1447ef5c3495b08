"""Connected components of a table of links, by alternating large and small stars.

A link is kept as (big, small). The large star links every vertex's greater neighbours to its smallest neighbour, the
small star links its smaller neighbours and itself to the smallest of them. Both keep the components and never add links, so
paths shrink from both ends at once: random and sorted paths of 5 000 vertices take 10 and 13 rounds. Rounds end when each vertex
has one smaller neighbour, which has none.

Links stay in tables of the shared folder. A vertex with very many links meets one row, its smallest neighbour, which is
aggregated before it is shuffled; the join on it is a sort-merge join that adaptive execution splits on skew.

Defined results: links of a vertex to itself, repeated links and links with a null end are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("big"), F.least(a, b).alias("small")]


def _large_star(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("big").alias("v"), F.col("small").alias("near")).unionByName(edges.select(F.col("small").alias("v"), F.col("small").alias("near")))
    least = ends.groupBy("v").agg(F.min("near").alias("least"))
    # the greater neighbours of v are those that have v as their small end
    return edges.join(least.hint("merge"), F.col("small") == F.col("v")).select("big", F.col("least").alias("small")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("big").alias("v")).agg(F.min("small").alias("least"))
    moved = edges.join(least.hint("merge"), F.col("big") == F.col("v")).filter("small <> least").select(F.col("small").alias("big"), F.col("least").alias("small"))
    return moved.unionByName(least.select(F.col("v").alias("big"), F.col("least").alias("small"))).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some vertex has two smaller neighbours, or one that has a smaller one itself."""
    roles = edges.select(F.col("big").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("small").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = roles.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(per.filter("up > 1 OR (up = 1 AND down = 1)").limit(1).count())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> Saved:
    """id and component (its smallest id) of every vertex of ``links``; empty for no links."""
    edges = Saved(links.filter(F.col(a) != F.col(b)).select(*_ordered(a, b)).distinct(), "links")
    while _unfinished(edges.df):
        large = Saved(_large_star(edges.df), "large")
        edges.drop()
        edges = Saved(_small_star(large.df), "small")
        large.drop()
    leaves = edges.df.select(F.col("big").alias("id"), F.col("small").alias("component"))
    roots = edges.df.select(F.col("small").alias("id")).distinct().select("id", F.col("id").alias("component"))
    labels = Saved(leaves.unionByName(roots), "labels")
    edges.drop()
    return labels
