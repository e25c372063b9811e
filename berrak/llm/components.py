"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berrak.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node of ``edges`` (a, b: longs).

    Each round points every node at its smallest neighbour, follows the pointers once more, and
    replaces nodes by what they point at, which leaves fewer nodes and edges; both tables are
    written each round, so that lineage does not grow. Nothing is collected but a count.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    found = written(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("component", F.col("id")), "nodes")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to"))
        hop = first.select(F.col("node").alias("to"), F.col("to").alias("further"))
        point = written(first.join(hop, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "points")
        ends = left.join(point.toDF("a", "x"), "a").join(point.toDF("b", "y"), "b")
        left = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        found = written(found.join(point.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "nodes")
    return found
