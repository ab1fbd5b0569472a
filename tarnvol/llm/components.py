"""Connected components by alternating large-star and small-star steps, staged between rounds.

Nodes may be of any type with an order.  A loop or a repeated link adds nothing; a link with a
null end is dropped; an empty table has no components; other columns are not read.  The links
of a hub are joined apart from their grouping, so that they can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import grouped, stage


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = grouped(both, ["u"], F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    least = grouped(down, ["u"], F.min("v").alias("m"))
    far = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return far.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Does every node point at one root that points nowhere?  One shuffle."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    open_ = ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
    return open_.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) undirected links -> (node, root): every node of a link but the roots, with the least node it reaches."""
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    while not _stars(edges):
        edges = stage(_small(_large(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
