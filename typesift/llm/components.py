"""Connected components of an edge table, by alternating star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm.session import materialize

MAX_ROUNDS = 60


def _lower_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours, hung on the smallest of them (edges: u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
        .select("e.u", "e.v").where("u > v").distinct()


def _upper_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, hung on the smallest in the node's neighbourhood."""
    least = edges.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("x")).select("w", F.col("w").alias("m")) \
        .unionByName(edges.select(F.col("u").alias("w"), F.col("v").alias("m"))).groupBy("w").agg(F.min("m").alias("m"))
    return edges.join(least, edges["v"] == least["w"]).select("u", F.col("m").alias("v")).where("u > v") \
        .unionByName(least.where("w > m").select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root: the smallest node reachable.

    Nodes without an edge to another node, and null ends, are left out.
    """
    stars = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .where("a is not null and b is not null and u > v").distinct())
    stars = materialize(stars, "edges")
    for _ in range(MAX_ROUNDS):
        # done when every node hangs on one node that hangs on none
        tangled = stars.join(stars.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        several = 0 if tangled else stars.groupBy("u").count().where("count > 1").limit(1).count()
        if not tangled and not several:
            roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        stars = materialize(_upper_star(_lower_star(stars)), "edges")
    raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
