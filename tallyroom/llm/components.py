"""Connected components of links between ids, by joins and grouping only.

Every node points at the smallest id it knows of. A round gives each node the smallest pointer
among its neighbours', hooks its old target under that, and then lets all pointers skip
to their target's target. Rounds go on until no pointer changes; a chain of n links takes about log n.
Pointers are written to the shared folder after each round, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every id in the links ``a, b``; the root is the smallest id of the component."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = written(both.groupBy("a", "b").agg(F.lit(1).alias("n")).select("a", "b"), "edges")
    nodes = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        of_b = edges.join(nodes.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        seen = written(nodes.join(of_b.withColumnRenamed("a", "node"), "node", "left").select(
            "node", "root", F.least("root", "near").alias("next")), "seen")
        # The old target learns of the smaller one, so whole trees move at once.
        hooks = seen.where("next < root").groupBy(F.col("root").alias("node")).agg(F.min("next").alias("hook"))
        moved = seen.join(hooks, "node", "left").select("node", "root", F.least("next", "hook").alias("next"))
        moved = written(moved, "moved")
        skip = moved.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = written(moved.join(skip, "next", "left").select("node", F.col("root").alias("old"), F.least("next", "far").alias("root")), "roots")
        nodes = new.select("node", "root")
        if new.where("old <> root").limit(1).count() == 0:
            return nodes
