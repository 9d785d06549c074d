"""Connected components of an edge list by alternating star contraction (Kiveris et al., 2014). Nothing of the graph goes to the driver but a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) are linked to the least of all."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # written first: a join of two plain shuffles is one whose hot nodes can be split
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "least")
    joined = both.join(least, both.u == least.n)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    out = stage(out.where("a <> b").distinct(), "edges")
    unstage(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node in ``edges`` (columns a and b); loops and repeated edges don't matter.

    Every round is written to the shared folder, and so is the result. Rounds end when the edges stay the same; their number grows with the
    logarithm of the longest chain."""
    edges = stage(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        large = _star(edges, True)
        unstage(edges)
        edges = _star(large, False)
        unstage(large)
    out = stage(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct()), "components")
    unstage(edges)
    return out
