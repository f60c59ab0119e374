"""Connected components of a link table, by contracting every node into its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.tables import drop_staged, stage


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links of long nodes -> (node, component), the component being one of its nodes.

    Each round maps a node to the smallest of itself and its neighbours and renames the links; what became
    one node leaves. Node numbers are hashes, hence in random order, so the number of rounds grows with
    the logarithm of a component's diameter. Neighbours are only aggregated, never gathered: a hub of any
    degree is one row of partial sums. Rounds are written tables, so a lost executor repeats no round.
    """
    links = stage(links.where("a <> b").select("a", "b"), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    members = stage(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "members")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        step = stage(least, "least")
        left = step.select(F.col("a"), F.col("to").alias("x"))
        right = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        renamed = links.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        after = stage(renamed.distinct(), "links")
        moved = stage(
            members.join(step.select(F.col("a").alias("component"), "to"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            ),
            "members",
        )
        drop_staged(links, step, members)
        links, members = after, moved
    return members
