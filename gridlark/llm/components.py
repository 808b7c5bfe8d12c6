"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so links, nodes and components stay distributed. A node with very many links, such as the
root of a large component, is pre-aggregated by the minimum, and its links are joined by a broadcast of that one row (``spread_join``).
Every step is a written table; those of earlier steps are deleted.

Defined results: links with a null end and links of a node with itself are left out; repeated links count once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.storage import HOT, drop_written, observed, spread_join, written


def _step(links: DataFrame, moving: str, moved: Column, stars: bool = False) -> DataFrame | None:
    """New edges (u, v) from the links (u, v, moving only those that ``moving`` says) and m, the least v of each u among all links.

    stars: links go both ways, and None is returned where they are all stars, which no step changes: no node with a lesser neighbour has another one.
    """
    ends = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least, seen = observed(ends, "least", total=F.sum("n"), most=F.max("n"), crossed=F.expr("count_if(m < u AND n > 1)"))
    edges = None
    if seen["crossed"] or not stars:
        hot = least.where(F.col("n") > seen["total"] / HOT) if seen["most"] > seen["total"] / HOT else None
        both = spread_join(links.where(moving), least.select("u", "m"), ["u"], hot)
        edges = written(both.select(F.explode(moved).alias("e")).select("e.*").where("u != v").distinct(), "edges")
    drop_written(least)
    return edges


def _large_star(edges: DataFrame) -> DataFrame | None:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _step(both, "v > u", F.array(F.struct(F.col("v").alias("u"), F.least("m", "u").alias("v"))), stars=True)


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _step(down, "true", F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node), for every node that has a link; links has the columns a and b."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a != b").distinct(), "edges")
    while (large := _large_star(edges)) is not None:
        drop_written(edges)
        edges = _small_star(large)
        drop_written(large)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
