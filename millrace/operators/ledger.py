"""Append-only consumption ledgers: effective streams, continuity, audits, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["step", "rank", "microbatch"]
BIN = 64


def simulate(events: DataFrame) -> DataFrame:
    """A ledger made of the events table: offsets are event ids; some rows are rollbacks, and
    what follows them serves the rolled-back steps again."""
    e = F.col("event_id")
    again = e % 40 < 5
    base = F.when(again & (e >= 40), e - 40).otherwise(e)
    return events.select(
        e.alias("offset"), F.when(e % 500 == 499, "rollback").otherwise("consumption").alias("type"), F.concat(F.lit("b"), F.floor(e / 4000)).alias("branch"),
        F.floor(base / 8).alias("step"), F.floor(base / 4).alias("quarter"), (base % 4).alias("microbatch"), F.when(again & (e >= 40), 2).otherwise(1).alias("attempt"),
        F.when(e % 500 == 499, e - 24).alias("to_offset"), F.col("user_id").alias("unit"), F.col("event_type").alias("lane"), F.col("value"),
    ).withColumn("rank", F.col("quarter") % 2).drop("quarter")


def superseded(ledger: DataFrame) -> DataFrame:
    """Rows of (branch, offset) that a rollback of their branch takes back.

    An interval join by bins of offsets: each rollback goes to the bins that it spans."""
    back = ledger.where("type = 'rollback'").select("branch", F.col("to_offset").alias("lo"), F.col("offset").alias("hi"))
    back = back.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN))))
    rows = ledger.where("type = 'consumption'").withColumn("bin", F.floor(F.col("offset") / BIN))
    return rows.join(back, ["branch", "bin"]).where("offset >= lo AND offset < hi").select("branch", "offset").distinct()


def effective(ledger: DataFrame) -> DataFrame:
    """What counts of a ledger: without superseded rows, and of several attempts at a place the last (the first of equal ones)."""
    rows = ledger.where("type = 'consumption'").join(superseded(ledger), ["branch", "offset"], "left_anti")
    best = Window.partitionBy("branch", *KEY).orderBy(F.col("attempt").desc(), "offset")
    return rows.withColumn("r_", F.row_number().over(best)).where("r_ = 1").drop("r_")


def continuity(stream: DataFrame) -> DataFrame:
    """By branch: events, steps, their range, missing steps, repeated places, distinct sizes of steps."""
    per = stream.groupBy("branch", "step").agg(F.count("*").alias("n"), F.countDistinct(F.struct(*KEY)).alias("places"))
    return per.groupBy("branch").agg(
        F.sum("n").alias("events"), F.count("*").alias("steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        (F.max("step") - F.min("step") + 1 - F.count("*")).alias("missing"), F.sum(F.col("n") - F.col("places")).alias("repeated"), F.countDistinct("n").alias("sizes"),
    )


def missing_steps(stream: DataFrame) -> DataFrame:
    """(branch, step): steps between a branch's first and last that it lacks: gaps by lag, no anti-join with all numbers."""
    steps = stream.select("branch", "step").distinct()
    before = F.lag("step").over(Window.partitionBy("branch").orderBy("step"))
    gaps = steps.withColumn("p", before).where("step > p + 1")
    return gaps.select("branch", F.explode(F.sequence(F.col("p") + 1, F.col("step") - 1)).alias("step"))


def pass_numbers(ledger: DataFrame, unit: str = "unit") -> DataFrame:
    """Adds pass_no: the how-manieth time that a unit is consumed."""
    return ledger.withColumn("pass_no", F.row_number().over(Window.partitionBy("branch", unit).orderBy("offset")))


def step_ranges(stream: DataFrame, tokens: Column) -> DataFrame:
    """(branch, step, token_start, token_end): half-open ranges of a branch's running token count."""
    per = stream.groupBy("branch", "step").agg(F.sum(tokens).alias("n"))
    end = F.sum("n").over(Window.partitionBy("branch").orderBy("step"))
    return per.withColumn("token_end", end).select("branch", "step", (F.col("token_end") - F.col("n")).alias("token_start"), "token_end")


def usefulness(first_loss: Column, last_loss: Column, max_grad: Column, exposures: Column, spike: float, margin: float = 0.01) -> Column:
    delta = first_loss - last_loss
    return F.when(max_grad > spike, "harmful").when(exposures < 2, "neutral").when(delta > margin, "useful").when(delta < -margin, "harmful").otherwise("neutral")
