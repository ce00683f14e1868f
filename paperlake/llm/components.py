"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.runtime import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: link the (larger / not larger) neighbours of every node to its smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(low, "u")
    if large:
        linked = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is linked to, for every node of ``edges`` (a, b).

    Two rounds of joins in turn until the set of edges stays as it is; then every edge leads from
    a node to the label of its component. Every round is written to the shared folder. The number
    of edges never grows, and a node with many neighbours is aggregated before it is shuffled.
    """
    edges = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if found == state or not found[0]:
            break
        state = found
        edges = durable(_star(_star(edges, True), False), "edges")
    labels = edges.groupBy("u").agg(F.min("v").alias("v"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return labels.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
