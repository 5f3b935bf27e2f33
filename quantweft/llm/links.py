"""Connected components over a table of links, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantweft.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of links (a, b: long) with the smallest node of its component.

    Large-star / small-star contraction: per round every node points its neighbours at the smallest it knows, until
    all point at the root.  Minima come from partial aggregation; joins on a hub can be split by AQE.
    """
    both = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = C.materialize(both, "edges")
    while True:
        large = _star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        small = C.materialize(_star(large, larger=False), "edges")
        if edges.count() == small.count() and edges.join(small, ["u", "v"], "left_anti").isEmpty():
            roots = small.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        edges = small


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Neighbours of u (the larger ones; or all, which are smaller) linked to the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(C.apart("u").alias("ux"), F.least("u", "m").alias("m"))
    joined = edges.withColumn("ux", C.apart("u")).join(least, "ux")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()
