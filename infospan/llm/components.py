"""Connected components of an edge table by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.llm.shared import spread_join, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (src, dst) to another: component is its component's smallest node.

    In each round every node hooks to its smallest neighbour, the trees are flattened by pointer jumping, and each is
    contracted to its root, so only edges between trees are left; rounds and jumps follow the logarithm of the longest
    path. Aggregates combine a hub's edges before the shuffle, and the joins on its end are salted. Each round's tables are written.
    """
    edges, found = edges.select("src", "dst").where("src <> dst"), None
    while True:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = _flattened(written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")), "hooked"))
        if found is None:
            found = roots
        else:
            further = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
            found = written(found.join(further, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")
        starts = spread_join(edges, roots.withColumnRenamed("node", "src"), ["src"], F.xxhash64("dst")).select(F.col("component").alias("src"), "dst")
        ended = spread_join(starts, roots.select(F.col("node").alias("dst"), F.col("component").alias("end")), ["dst"], F.xxhash64("src"))
        edges = written(ended.select("src", F.col("end").alias("dst")).where("src <> dst").distinct(), "contracted")
        if edges.isEmpty():
            return found


def _flattened(labels: DataFrame) -> DataFrame:
    """labels (node, component) with every label replaced by that of its own label, until each is a root's."""
    while True:
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = written(labels.join(above, "component").select("node", F.col("root").alias("component"), (F.col("root") != F.col("component")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels
