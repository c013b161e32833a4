"""Connected components of an edge table, by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, kept


def components(edges: DataFrame) -> DataFrame:
    """[node, root] for every node of edges[a, b]; root is the smallest node that is reachable.

    Each round takes the minimum of the neighbours' roots (combined in each task before the shuffle) and
    then follows the root's own root, so long chains shrink geometrically. A hub adds rows to a join that
    adaptive execution can split, never to one group.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    roots = kept(first.select("node", F.least("node", "b").alias("root")), "roots")
    while True:
        heard = both.join(roots, both.b == roots.node).select(F.col("a").alias("node"), "root", F.lit(False).alias("own"))
        near = heard.unionByName(roots.withColumn("own", F.lit(True))).groupBy("node")
        near = near.agg(F.min("root").alias("near"), F.max(F.when(F.col("own"), F.col("root"))).alias("before"))
        jump = roots.select(F.col("node").alias("near"), F.col("root").alias("far"))
        after = near.join(jump, "near").select("node", F.col("far").alias("root"), (F.col("far") != F.col("before")).alias("moved"))
        after = kept(after, "roots")
        drop(roots)
        moved = after.where("moved").limit(1).count()
        path, roots = after.kept_path, after.drop("moved")
        roots.kept_path = path
        if not moved:
            return roots
