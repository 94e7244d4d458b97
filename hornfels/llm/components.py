"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two joins or aggregations over narrow rows; its result is written to the shared scratch folder, so a
lost executor costs a few tasks, and joins against a star's centre read plain exchanges, which adaptive execution
splits when one centre holds many of the rows.  Nothing but row counts and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.llm.common import forget, persist


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) to (node, component), the smallest reachable node, for each node of an edge between two."""
    edges = persist(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while (now := _checksum(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = persist(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(smallest, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = persist(large.filter("a <> b").distinct())
        forget(edges, smallest)
        smallest = persist(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        small = large.join(smallest, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = persist(small.unionByName(smallest.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        forget(large, smallest)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
