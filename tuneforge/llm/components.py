"""Connected components of an edge table by alternating large and small stars.

Each round replaces an edge table by one with the same components in which nodes point to
smaller ones: a large star links every larger neighbour of a node to the least of its
neighbours, a small star every smaller one. Rounds are written to the shared checkpoint folder;
they end when a round changes nothing, with every node linked to the least of its component.
Nodes are values that can be compared; nothing is collected but a count and a hash of a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneforge.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("v", "p").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed)).first())


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("u"), F.col("p").alias("n")).union(edges.select(F.col("p").alias("u"), F.col("v").alias("n")))
    least = both.groupBy("u").agg(F.min("n").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("n > u").join(least, "u").select(F.col("n").alias("v"), F.col("m").alias("p")).where("v <> p").distinct()
    least = large.groupBy("v").agg(F.min("p").alias("m"))
    small = large.join(least, "v")
    return small.select(F.explode(F.array(F.struct("v", F.col("m").alias("p")), F.struct(F.col("p").alias("v"), F.col("m").alias("p")))).alias("e")).select("e.*").where("v <> p").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node of its component, for every node that has an edge to another."""
    ordered = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p")).distinct()
    now = written(ordered)
    mark = _mark(now)
    while mark[0]:
        after = written(_round(now))
        new = _mark(after)
        now, same = after, new == mark
        mark = new
        if same:
            break
    roots = now.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("p").alias("component")).union(roots)
