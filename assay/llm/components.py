"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node: (node, component).

    ``edges`` has columns a and b. Each round hooks every node's neighbours, and its own label,
    to the least node in sight (large-star and small-star steps), so rounds grow with the
    logarithm of the path length; edges are written between rounds and never collected.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "edges")
    before = None
    while True:
        # large star: neighbours above a node go to the least node that it sees
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(star.where("a <> b").distinct(), "edges")
        # small star: neighbours below a node go to the least of them, and so does the node
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        star = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(star.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        before = now
