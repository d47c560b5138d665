"""From verified links between classes of copies to groups and link counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import shared_table
from riskframe.llm.components import components


def grouped(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, n_links, best) of every class.

    ``classes`` has ``node``, ``copies`` (rows of the class) and ``best`` (its
    representative row, the smallest wins); ``found`` has partial results of
    block tasks: ``node``, ``links`` (rows of other classes linked there) and
    ``root`` (a node it is connected to).  ``best`` becomes the smallest of the
    whole group; ``n_links`` includes the other copies of the class."""
    found = shared_table(found)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.where("node != root"), "node", "root")
    rows = (classes.select("node", "copies", "best")
            .join(counts, "node", "left").join(group, "node", "left")
            .withColumn("root", F.coalesce("root", "node")))
    best = rows.groupBy("root").agg(F.min("best").alias("group_best"))
    return rows.join(best, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("group_best").alias("best"))
