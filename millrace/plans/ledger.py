"""Queries over a consumption ledger, made of the events table, and its audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import ledger as O
from millrace.plans.base import query
from millrace.sources.tables import table

L = """b AS (SELECT *, CASE WHEN event_id % 40 < 5 AND event_id >= 40 THEN event_id - 40 ELSE event_id END AS base FROM events),
l AS (SELECT event_id AS offset_, CASE WHEN event_id % 500 = 499 THEN 'rollback' ELSE 'consumption' END AS type, 'b' || (event_id // 4000) AS branch, base // 8 AS step, (base // 4) % 2 AS rank, base % 4 AS microbatch,
  CASE WHEN event_id % 40 < 5 AND event_id >= 40 THEN 2 ELSE 1 END AS attempt, CASE WHEN event_id % 500 = 499 THEN event_id - 24 END AS to_offset, user_id AS unit, event_type AS lane, value FROM b),
w AS (SELECT branch, to_offset AS lo, offset_ AS hi FROM l WHERE type = 'rollback'),
x AS (SELECT * FROM l WHERE type = 'consumption' AND NOT EXISTS (SELECT 1 FROM w WHERE w.branch = l.branch AND l.offset_ >= lo AND l.offset_ < hi)),
eff AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY branch, step, rank, microbatch ORDER BY attempt DESC, offset_) = 1),
rg AS (SELECT branch, step, CAST(sum(n) OVER (PARTITION BY branch ORDER BY step) - n AS BIGINT) AS token_start, CAST(sum(n) OVER (PARTITION BY branch ORDER BY step) AS BIGINT) AS token_end FROM (SELECT branch, step, sum(100 + unit) AS n FROM eff GROUP BY ALL))"""
SERIES = "s AS (SELECT CAST(event_id // 100 AS BIGINT) AS step, round(avg(value), 6) AS loss FROM events GROUP BY 1)"


def ledger(spark, d):
    return O.simulate(table(spark, d, "events"))


def effective(spark, d):
    return O.effective(ledger(spark, d))


@query("ledger_append", f"WITH {L} SELECT type, branch, count(*) AS events, min(offset_) AS first_offset, max(offset_) AS last_offset FROM l GROUP BY ALL")
def ledger_append(spark, d):
    return ledger(spark, d).groupBy("type", "branch").agg(F.count("*").alias("events"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query("ledger_pass_no", f"WITH {L} SELECT offset_ AS \"offset\", unit, CAST(row_number() OVER (PARTITION BY branch, unit ORDER BY offset_) AS INTEGER) AS pass_no FROM l WHERE type = 'consumption'")
def ledger_pass_no(spark, d):
    return O.pass_numbers(ledger(spark, d).where("type = 'consumption'")).select("offset", "unit", "pass_no")


@query("ledger_rollback", f"WITH {L} SELECT w.branch, w.hi AS rollback_offset, count(l.offset_) AS superseded FROM w LEFT JOIN l ON l.type = 'consumption' AND l.branch = w.branch AND l.offset_ >= lo AND l.offset_ < hi GROUP BY ALL")
def ledger_rollback(spark, d):
    rows = ledger(spark, d)
    back = rows.where("type = 'rollback'").select("branch", F.col("offset").alias("rollback_offset"), F.col("to_offset").alias("lo"))
    bins = back.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / O.BIN), F.floor(F.col("rollback_offset") / O.BIN))))
    own = rows.where("type = 'consumption'").select("branch", "offset", F.floor(F.col("offset") / O.BIN).alias("bin"))
    met = bins.join(own, ["branch", "bin"]).where("offset >= lo AND offset < rollback_offset").groupBy("branch", "rollback_offset").agg(F.count("*").alias("n"))
    return back.join(met, ["branch", "rollback_offset"], "left").select("branch", "rollback_offset", F.coalesce("n", F.lit(0)).alias("superseded"))


@query("ledger_effective", f"WITH {L} SELECT branch, step, rank, microbatch, attempt, offset_ AS \"offset\" FROM eff")
def ledger_effective(spark, d):
    return effective(spark, d).select("branch", "step", "rank", "microbatch", "attempt", "offset")


@query("ledger_effective_until", f"WITH {L} SELECT branch, count(*) AS events FROM eff WHERE step < 300 GROUP BY branch")
def ledger_effective_until(spark, d):
    return effective(spark, d).where("step < 300").groupBy("branch").agg(F.count("*").alias("events"))


@query("ledger_continuity", f"WITH {L}, p AS (SELECT branch, step, count(*) AS n, count(DISTINCT rank || '/' || microbatch) AS places FROM eff GROUP BY ALL) SELECT branch, CAST(sum(n) AS BIGINT) AS events, count(*) AS steps, min(step) AS first_step, max(step) AS last_step, max(step) - min(step) + 1 - count(*) AS missing, CAST(sum(n - places) AS BIGINT) AS repeated, count(DISTINCT n) AS sizes FROM p GROUP BY branch")
def ledger_continuity(spark, d):
    return O.continuity(effective(spark, d))


@query("ledger_missing_steps", f"WITH {L}, r AS (SELECT branch, unnest(range(min(step), max(step) + 1)) AS step FROM (SELECT * FROM eff WHERE step % 13 <> 5) GROUP BY branch) SELECT branch, step FROM r WHERE NOT EXISTS (SELECT 1 FROM eff WHERE eff.branch = r.branch AND eff.step = r.step AND step % 13 <> 5)")
def ledger_missing_steps(spark, d):
    """Every thirteenth step is left out first, so that there are gaps."""
    return O.missing_steps(effective(spark, d).where("step % 13 <> 5"))


@query("ledger_branches", f"WITH {L} SELECT branch, count(*) AS events, min(step) AS first_step, max(step) AS last_step, array_to_string(list_sort(list_distinct(list(attempt))), ',') AS attempts, array_to_string(list_sort(list_distinct(list(type))), ',') AS types FROM l GROUP BY branch")
def ledger_branches(spark, d):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return ledger(spark, d).groupBy("branch").agg(F.count("*").alias("events"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), joined("attempt").alias("attempts"), joined("type").alias("types"))


@query("ledger_step_ranges", f"WITH {L} SELECT * FROM rg")
def ledger_step_ranges(spark, d):
    return O.step_ranges(effective(spark, d), F.col("unit") + 100)


@query("ledger_audit_range", f"WITH {L} SELECT e.branch, e.lane, count(*) AS events, min(e.step) AS first_step, max(e.step) AS last_step FROM eff e JOIN rg USING (branch, step) WHERE token_end > 20000 AND token_start < 60000 GROUP BY ALL")
def ledger_audit_range(spark, d):
    """Which lanes fed tokens 20,000 to 60,000 of each branch."""
    e = effective(spark, d)
    hit = O.step_ranges(e, F.col("unit") + 100).where("token_end > 20000 AND token_start < 60000")
    return e.join(hit, ["branch", "step"]).groupBy("branch", "lane").agg(F.count("*").alias("events"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("ledger_checkpoint_check", f"WITH {L}, c AS (SELECT unnest(range(50, 500, 50)) AS k) SELECT CAST(k AS BIGINT) AS \"at\", count(e.step) AS before, k * 8 AS expected FROM c LEFT JOIN eff e ON e.branch = 'b0' AND e.step < k GROUP BY k")
def ledger_checkpoint_check(spark, d):
    """Events before each checkpoint, by a running count and an as-of join."""
    per = effective(spark, d).where("branch = 'b0'").groupBy("step").agg(F.count("*").alias("n"))
    marks = spark.range(50, 500, 50).select(F.col("id").alias("at"))
    joined = marks.join(per, F.expr("step < at"), "left").groupBy("at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    return joined.select("at", "before", (F.col("at") * 8).alias("expected"))


@query("ledger_replay_compare", f"WITH {L} SELECT a.step, count(*) AS places, count(*) FILTER (a.unit = b.unit) AS same_unit, bool_and(a.lane = b.lane) AS same_lanes FROM eff a JOIN eff b ON b.branch = 'b1' AND a.branch = 'b0' AND b.step - 500 = a.step AND a.rank = b.rank AND a.microbatch = b.microbatch GROUP BY a.step")
def ledger_replay_compare(spark, d):
    """Two branches place by place."""
    e = effective(spark, d)
    a = e.where("branch = 'b0'").select(*O.KEY, F.col("unit").alias("ua"), F.col("lane").alias("la"))
    b = e.where("branch = 'b1'").select((F.col("step") - 500).alias("step"), "rank", "microbatch", F.col("unit").alias("ub"), F.col("lane").alias("lb"))
    return a.join(b, O.KEY).groupBy("step").agg(F.count("*").alias("places"), F.count_if(F.col("ua") == F.col("ub")).alias("same_unit"), F.bool_and(F.col("la") == F.col("lb")).alias("same_lanes"))


@query("loss_spike", f"WITH {SERIES}, j AS (SELECT *, loss - lag(loss) OVER (ORDER BY step) AS jump FROM s) SELECT arg_max(step, jump) AS step, round(max(jump), 6) AS jump FROM j")
def loss_spike(spark, d):
    s = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.round(F.avg("value"), 6).alias("loss"))
    j = s.withColumn("jump", F.col("loss") - F.lag("loss").over(Window.orderBy("step")))
    return j.agg(F.max_by("step", "jump").alias("step"), F.round(F.max("jump"), 6).alias("jump"))


@query("trace_grouping_sets", "SELECT event_type AS lane, CAST(user_id % 16 AS BIGINT) AS shard, CAST(event_id // 64 % 8 AS BIGINT) AS bucket, count(*) AS tokens, round(sum(value), 4) AS loss_sum, count(*) FILTER (value > 60) AS high, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 16), (event_id // 64 % 8))")
def trace_grouping_sets(spark, d):
    """Three roll-ups of a token trace in one pass."""
    table(spark, d, "events").createOrReplaceTempView("events_trace")
    return spark.sql(
        "SELECT lane, shard, bucket, count(*) AS tokens, round(sum(value), 4) AS loss_sum, count_if(value > 60) AS high, round(avg(value), 6) AS mean "
        "FROM (SELECT event_type AS lane, user_id % 16 AS shard, (event_id div 64) % 8 AS bucket, value FROM events_trace) GROUP BY GROUPING SETS ((lane), (shard), (bucket))"
    )


@query("trace_tiers", "SELECT CASE WHEN event_id // 100 BETWEEN 10 AND 20 THEN 'full' WHEN event_id // 100 % 5 = 0 THEN 'quantized' ELSE 'none' END AS tier, count(*) AS rows_, round(avg(exp(least(value / 50, 20))), 4) AS perplexity FROM events GROUP BY 1")
def trace_tiers(spark, d):
    step = F.floor(F.col("event_id") / 100)
    tier = F.when(step.between(10, 20), "full").when(step % 5 == 0, "quantized").otherwise("none")
    return table(spark, d, "events").groupBy(tier.alias("tier")).agg(F.count("*").alias("rows_"), F.round(F.avg(F.exp(F.least(F.col("value") / 50, F.lit(20)))), 4).alias("perplexity"))


LEARN = "g AS (SELECT user_id AS shard, any_value(event_type) FILTER (event_id = m) AS lane, count(*) AS exposures, arg_min(value, event_id) AS first_loss, arg_max(value, event_id) AS last_loss, max(value) AS max_grad, min(event_id) AS first_step, max(event_id) AS last_step, avg(value) AS mean FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id), k AS (SELECT *, CASE WHEN max_grad > 150 THEN 'harmful' WHEN exposures < 2 THEN 'neutral' WHEN first_loss - last_loss > 0.01 THEN 'useful' WHEN first_loss - last_loss < -0.01 THEN 'harmful' ELSE 'neutral' END AS class FROM g)"


def learning(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("shard")).agg(
        F.min_by("event_type", "event_id").alias("lane"), F.count("*").alias("exposures"), F.min_by("value", "event_id").alias("first_loss"), F.max_by("value", "event_id").alias("last_loss"),
        F.max("value").alias("max_grad"), F.min("event_id").alias("first_step"), F.max("event_id").alias("last_step"), F.avg("value").alias("mean"),
    )
    return g.withColumn("class", O.usefulness(F.col("first_loss"), F.col("last_loss"), F.col("max_grad"), F.col("exposures"), 150.0))


@query("learning_ledger", f"WITH {LEARN} SELECT shard, lane, exposures, round(first_loss - last_loss, 4) AS delta, first_step, last_step, class FROM k")
def learning_ledger(spark, d):
    return learning(spark, d).select("shard", "lane", "exposures", F.round(F.col("first_loss") - F.col("last_loss"), 4).alias("delta"), "first_step", "last_step", "class")


@query("lane_rollup", f"WITH {LEARN}, c AS (SELECT lane, class, count(*) AS n FROM k GROUP BY ALL), b AS (SELECT lane, arg_max(class, n * 10 - CASE class WHEN 'useful' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END) AS modal FROM c GROUP BY lane) SELECT lane, count(*) AS shards, round(avg(mean), 6) AS mean_of_means, any_value(modal) AS modal FROM k JOIN b USING (lane) GROUP BY lane")
def lane_rollup(spark, d):
    """Means of shard means (not of rows), and the most frequent class; ties: useful, neutral, harmful."""
    k = learning(spark, d)
    tie = F.when(F.col("class") == "useful", 0).when(F.col("class") == "neutral", 1).otherwise(2)
    modal = k.groupBy("lane", "class").agg(F.count("*").alias("n")).groupBy("lane").agg(F.max_by("class", F.struct("n", -tie)).alias("modal"))
    return k.groupBy("lane").agg(F.count("*").alias("shards"), F.round(F.avg("mean"), 6).alias("mean_of_means")).join(modal, "lane")


@query("compliance", f"WITH {L}, t AS (SELECT lane, count(*) AS n FROM eff GROUP BY lane), a AS (SELECT lane, n::DOUBLE / sum(n) OVER () AS actual FROM t) SELECT lane, round(actual, 6) AS actual, round(actual - 0.2, 6) AS drift, abs(actual - 0.2) <= 0.03 AS within FROM a")
def compliance(spark, d):
    """Served against planned shares (here: a fifth each)."""
    t = effective(spark, d).groupBy("lane").agg(F.count("*").alias("n"))
    actual = F.col("n") / F.sum("n").over(Window.partitionBy())
    return t.select("lane", F.round(actual, 6).alias("actual"), F.round(actual - 0.2, 6).alias("drift"), (F.abs(actual - 0.2) <= 0.03).alias("within"))


@query("compliance_floors", f"WITH {L}, s AS (SELECT branch, step, lane, (dense_rank() OVER (PARTITION BY branch ORDER BY step) - 1) // 10 AS grp FROM eff) SELECT branch, CAST(grp AS BIGINT) AS grp, count(*) AS events, count(*) FILTER (lane = 'error') AS served, count(*) FILTER (lane = 'error') >= 0.12 * count(*) AS met FROM s GROUP BY ALL")
def compliance_floors(spark, d):
    """A floor of 12 % over every ten observed steps."""
    g = F.floor((F.dense_rank().over(Window.partitionBy("branch").orderBy("step")) - 1) / 10)
    s = effective(spark, d).withColumn("grp", g)
    served = F.count_if(F.col("lane") == "error")
    return s.groupBy("branch", "grp").agg(F.count("*").alias("events"), served.alias("served"), (served >= 0.12 * F.count("*")).alias("met"))


@query("throughput", f"WITH {L} SELECT branch, CAST(sum(100 + unit) AS BIGINT) AS raw, CAST(sum(CASE WHEN e.offset_ IS NOT NULL THEN 100 + unit ELSE 0 END) AS BIGINT) AS accepted, round(sum(CASE WHEN e.offset_ IS NOT NULL THEN 100 + unit ELSE 0 END)::DOUBLE / sum(100 + unit), 6) AS share FROM (SELECT * FROM l WHERE type = 'consumption') l LEFT JOIN (SELECT branch, offset_ FROM eff) e USING (branch, offset_) GROUP BY branch")
def throughput(spark, d):
    rows = ledger(spark, d).where("type = 'consumption'")
    good = effective(spark, d).select("branch", "offset", F.lit(1).alias("good"))
    n = F.col("unit") + 100
    got = F.sum(F.when(F.col("good") == 1, n).otherwise(0))
    return rows.join(good, ["branch", "offset"], "left").groupBy("branch").agg(F.sum(n).alias("raw"), got.alias("accepted"), F.round(got / F.sum(n), 6).alias("share"))
