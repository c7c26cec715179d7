"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.sources.store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (src, dst): component is the least node reachable.

    Each round gives a node the least label next to it, then that label's own label, so that labels run along a path in
    steps that double; rounds follow the logarithm of the longest path. Every round is written. Null ends are left out.
    """
    both = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    both = written(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        found = written(least.join(above, "component").select("node", F.least("component", "up").alias("component"), (F.least("component", "up") != F.col("old")).alias("moved")), "labels")
        labels = found.select("node", "component")
        if found.where("moved").isEmpty():
            return labels
