"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import join_counted, settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its neighbours to the least of itself and them.

    ``edges``: distinct (u, v) with u > v. In a large star a node links the
    neighbours above it, in a small star those below it and itself.
    """
    ends = edges.select("u", "v")
    if large:
        ends = ends.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ends.groupBy("u").agg(F.min("v").alias("w"), F.count(F.lit(1)).alias("n")).withColumn("w", F.least("w", "u"))
    # A large star's centre has all its leaves as neighbours; below a node there are few.
    joined = join_counted(ends, settle(least, "centres"), ["u"], "n", ["v"]) if large else ends.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("w").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("w").alias("v")).union(joined.select("u", F.col("w").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every node of ``edges`` (a, b): the least id it can reach.

    Each round is two joins on node ids and is written to the shared folder, so
    that the plan doesn't grow; the number of rounds follows the logarithm of the
    longest chain. When every edge points at a node that has no edge to a lower
    one, the edges are the answer. Only the count of open edges reaches the driver.
    """
    now = settle(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # Done if each upper end has one edge and no lower end is an upper end too.
        many = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1)
        chain = now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi").limit(1)
        if many.select("u").union(chain).isEmpty():
            break
        now = settle(_stars(_stars(now, large=True), large=False), "edges")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
