"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per vertex (combined on the map side) and a join back on the vertex
(AQE splits a hub).  The edge table is written to the shared folder after every round, so
lineage stays short and nothing but two counts reaches the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if larger else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, component (its smallest vertex) of every vertex of ``edges`` (columns a, b)."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        edges = stored(_star(_star(edges, True), False), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = edges.select(F.col("b").alias("v")).distinct().withColumn("component", F.col("v"))
    return edges.select(F.col("a").alias("v"), F.col("b").alias("component")).union(roots)
