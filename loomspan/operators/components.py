"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.tables import forget, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of ``links`` (a, b) with the smallest node of its component.

    Rounds go on until the links are stars; their number grows with the logarithm of the longest path. Each round's
    links are written, so lineage stays short.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        # done when the edges are stars: one edge from each greater node, to a node that has none
        many = edges.groupBy("a").agg(F.count("*").alias("n"))
        middle = many.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")
        if many.filter("n > 1").select("a").union(middle).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        # large star: greater neighbours of a node point to the smallest of its neighbourhood
        low = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").union(low.filter("a <> m").select("a", F.col("m").alias("b"))).distinct(), "large")
        # small star: a node and its smaller neighbours point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        small = materialize(small, "small")
        forget(edges, large)
        edges = small
