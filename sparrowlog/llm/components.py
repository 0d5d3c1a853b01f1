"""Connected components of an edge table, by minimum labels with pointer jumping; all state stays in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of (a, b); a component is named by its least node. Rounds grow as the logarithm of a component's diameter."""
    both = materialise(edges.select("a", "b").filter("a <> b").union(edges.select("b", "a").filter("a <> b")).toDF("node", "other").distinct(), "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        seen = both.join(labels.toDF("other", "seen"), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        near = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("near"))
        jump = labels.toDF("near", "far")
        after = materialise(near.join(jump, "near", "left").select("node", "old", F.least("near", "far").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.filter("component <> old").isEmpty():
            return labels
