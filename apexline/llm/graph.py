"""Connected components over an edge list, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.functions.session import cut_unsized


def components(edges: DataFrame) -> DataFrame:
    """node, root for edges (a, b); root is the component's smallest node.

    A step takes the smallest label among a node's neighbours, then the label of that label, so
    that the reach of a label doubles. Hubs are no problem: the joins are on nodes and can be split
    by Spark, and minima are taken before the shuffle.
    """
    ways = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    ways = cut_unsized(ways)
    labels = cut_unsized(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("root"), F.lit(True).alias("moved")
    ))
    while not labels.filter("moved").isEmpty():
        known = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        near = ways.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(near, "node").select(
            "node", "root", F.least("root", "near").alias("next")
        )
        ahead = labels.select(F.col("node").alias("next"), F.col("root").alias("further"))
        labels = cut_unsized(hooked.join(ahead, "next", "left").select(
            "node",
            F.least("next", "further").alias("new"),
            "root",
        ).select("node", F.col("new").alias("root"), (F.col("new") < F.col("root")).alias("moved")))
    return labels.select("node", "root")
