"""Greedy and component keeps reach the end of every chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import dedup


def bands(pairs):
    """A band for each pair."""
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), F.lit(0).alias("band"), F.concat_ws("-", "a", "b").alias("key"))


def test_long_chain_is_scanned_to_its_end(spark):
    n = 105  # 52 rounds
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long").coalesce(1)
    assert sorted(r["doc_id"] for r in dedup.greedy_duplicates(bands(pairs)).collect()) == list(range(1, n, 2))


def test_component_keep(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(3, 90), (5, 90), (5, 91), (1, 91), (2, 4)]
    pairs = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    got = sorted(r["doc_id"] for r in dedup.component_duplicates(bands(pairs)).collect())
    assert got == sorted([*range(11, 41), 3, 5, 90, 91, 4])
    assert dedup.component_duplicates(bands(pairs.where("a < 0"))).isEmpty() and dedup.greedy_duplicates(bands(pairs.where("a < 0"))).isEmpty()


def test_hot_band_needs_no_pairs(spark):
    """3,000 documents in one band, each also in one of its own."""
    keys = spark.range(3000).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit("all"), F.col("id").cast("string"))).alias("key")).withColumn("band", F.lit(0))
    assert dedup.greedy_duplicates(keys).count() == dedup.component_duplicates(keys).count() == dedup.later_members(keys).count() == 2999
