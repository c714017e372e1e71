"""Shard payload tables with read accounting, run control over ledgers, and cleaning of documents in segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T


def write_shards(rows: DataFrame, path: str, lane: str = "lane", shard: str = "shard") -> None:
    """Payload rows as a table with a folder for each lane and shards together in its files, so that a read of one lane
    or shard opens no other lane."""
    rows.repartition(F.col(lane), F.col(shard)).sortWithinPartitions(lane, shard).write.partitionBy(lane).option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, lanes: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if lanes is None else df.where(F.col("lane").isin(lanes))


def cache_accounting(reads: DataFrame, order: str, shard: str = "shard") -> DataFrame:
    """One row for (shard, order): a shard's first read is a miss, later ones are hits.  Counts alone say so."""
    n = reads.groupBy(shard).agg(F.count("*").alias("n"))
    total = n.agg(F.count("*").alias("shard_reads"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("cache_hits"))
    rate = F.coalesce(F.try_divide("cache_hits", F.col("cache_hits") + F.col("shard_reads")), F.lit(0.0))
    return total.withColumn("cache_hit_rate", F.round(rate, 4))


def clean_segments(segments: DataFrame, prose: Column, tags: dict[str, str] | None = None) -> DataFrame:
    """(doc, turn, role, text, pii_removed) of segments (doc, turn, role, text): normalised, ghost tags taken out of prose,
    personal data masked; roles stay, and segments that become empty go."""
    text = T.normalize(F.when(prose, T.strip_ghosts(F.col("text"))).otherwise(F.col("text")))
    done, counts = T.masked(F.col("normal"), tags)
    cleaned = segments.withColumn("normal", text).withColumns({"pii_removed": sum(counts.values()), "clean": done})
    return cleaned.where(F.length("clean") > 0).select("doc", "turn", "role", F.col("clean").alias("text"), "pii_removed")


def resumed(events: DataFrame, checkpoint_step: int, crash_step: int, recomputed: DataFrame) -> DataFrame:
    """The ledger of a run that fell at crash_step and went on from its checkpoint: what came after the checkpoint
    before the crash is superseded by what was computed again."""
    return events.where((F.col("step") < checkpoint_step) & (F.col("step") <= crash_step)).unionByName(recomputed.where(F.col("step") >= checkpoint_step))


def against(main: DataFrame, branch: DataFrame, name: str) -> DataFrame:
    """(branch, steps, same, first_difference) of a branch's (step, hash) against the main run's."""
    met = main.select("step", F.col("hash").alias("a")).join(branch.select("step", F.col("hash").alias("b")), "step", "full")
    same = F.col("a").eqNullSafe(F.col("b"))
    return met.agg(F.count("b").alias("steps"), F.count_if(same).alias("same"), F.min(F.when(~same, F.col("step"))).alias("first_difference")).select(F.lit(name).alias("branch"), "steps", "same", "first_difference")


def utf8_cut(text: Column, n: int) -> Column:
    """At most n bytes of a text, without a character that is cut."""
    data = F.encode(text, "UTF-8")
    head, following = F.hex(F.substring(data, 1, n)), F.hex(F.substring(data, n + 1, 1))
    whole = F.when(following.rlike("^[89AB]"), F.regexp_replace(head, "[C-F][0-9A-F](?:[89AB][0-9A-F])*$", "")).otherwise(head)
    return F.decode(F.unhex(whole), "UTF-8")
