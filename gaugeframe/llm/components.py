"""Connected components of an edge table by contraction, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.data import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Every node hooks to its smallest neighbour if that is smaller; chains are halved until
    each points to its end; edges are rewritten to the ends and the rest goes on. A round
    leaves at most half of the nodes that still have edges. All tables are stored in the
    shared folder, nothing but counts reaches the driver. Joins on a hot end stay joins, so
    that skewed ones are split.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parent = stored(parent.select("node", F.least("node", "low").alias("up")), "parents")
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents")
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        up = parent.withColumnRenamed("node", "root")
        mapping = stored(mapping.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        ends = [parent.select(F.col("node").alias(c), F.col("up").alias(f"new_{c}")) for c in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).where("a <> b")
        edges = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return mapping
