"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import drop_table, materialize


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (src, dst); a component is named by its least node.

    Nulls, self-loops and repeated edges are allowed; an edge with a null end is ignored.
    Least neighbours come from partial aggregates, and the joins are ones that adaptive
    execution splits, so a node with a third of all edges needs no task of its own.
    Each round's edges are written to the shared folder.
    """
    known = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    loops = known.select(F.col("src").alias("node")).union(known.select(F.col("dst").alias("node"))).distinct()
    nodes = materialize(spark, loops, "nodes")
    now = materialize(spark, known.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        both = now.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(now.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()
        large = materialize(spark, large, "large")
        lower = large.groupBy("src").agg(F.min("dst").alias("m"))
        joined = large.join(lower, "src")
        small = joined.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(lower.select("src", F.col("m").alias("dst"))).distinct()
        after = materialize(spark, small, "edges")
        drop_table(spark, large)
        drop_table(spark, now)
        now = after
    return nodes.join(now.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
