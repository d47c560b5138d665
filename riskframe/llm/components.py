"""Connected components of an edge table by alternating star contractions.

Each round is a shuffle of at most as many rows as there are edges; an edge
list that holds a hub is never collected per node (a minimum per node is
pre-aggregated).  Rounds are written to the shared checkpoint folder, so a lost
executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import shared_table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node on an edge; ``root`` is the smallest node of
    its component.  Null ends and loops are ignored."""
    now = shared_table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                       .where("u > v").distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        # every node points to the smallest node it touches, and so do its larger neighbours
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        # each node's smaller neighbours point to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        now = shared_table(small)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
                        .alias("h")).first()
        if before == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
