"""Queries of mixture schedules and of candidate selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import mixture as O
from millrace.operators.runs import numbered
from millrace.plans.base import query
from millrace.sources.tables import table

_V = ", ".join(f"({i}, '{n}', {f}, {w})" for i, (n, f, w, _) in enumerate(O.STAGES))
_M = ", ".join(f"({i}, '{lane}', {x})" for i, (_, _, _, m) in enumerate(O.STAGES) for lane, x in zip(O.LANES, m, strict=True))
STAGE = f"""v AS (SELECT * FROM (VALUES {_V}) AS t(i, stage, frac, warm)),
s0 AS (SELECT *, greatest(1, CAST(round_even(frac * 80, 0) AS INTEGER)) AS size FROM v),
s AS (SELECT i, stage, CAST(coalesce(sum(size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS step_start,
  CASE WHEN i = 4 THEN 80 ELSE CAST(least(80, sum(size) OVER (ORDER BY i)) AS INTEGER) END AS step_end, warm FROM s0),
st AS (SELECT i, stage, step_start, step_end, CAST(round_even(CAST(warm AS DOUBLE) * (step_end - step_start), 0) AS INTEGER) AS warmup_steps FROM s),
m AS (SELECT i, lane, CAST(x AS DOUBLE) AS x FROM (VALUES {_M}) AS t(i, lane, x)),
b AS (SELECT step, m.lane, CASE WHEN st.i > 0 AND step - step_start < warmup_steps THEN (1 - (step - step_start + 1)::DOUBLE / (warmup_steps + 1)) * p.x + (step - step_start + 1)::DOUBLE / (warmup_steps + 1) * m.x ELSE m.x END AS x
  FROM range(0, 80) AS r(step) JOIN st ON step >= step_start AND step < step_end JOIN m USING (i) LEFT JOIN m p ON p.i = m.i - 1 AND p.lane = m.lane),
sh AS (SELECT CAST(step AS INTEGER) AS step, lane, x / sum(x) OVER (PARTITION BY step) AS share FROM b)"""


@query("stage_compile", f"WITH {STAGE} SELECT stage, step_start, step_end, warmup_steps FROM st")
def stage_compile(spark, d):
    return O.stage_table(spark, O.Schedule())


@query("mixture_at_step", f"WITH {STAGE} SELECT step, lane, round(share, 6) AS share FROM sh")
def mixture_at_step(spark, d):
    return O.shares_table(spark, O.Schedule()).select("step", "lane", F.round("share", 6).alias("share"))


_AT = f"list_position([{', '.join(repr(x) for x in O.LANES)}], lane)"
#: Sums of doubles in the order of lanes and of steps: one mean lies at the edge of rounding, where any other order is chance.
ORDERED = f"""t AS (SELECT step, list_reduce(list(x ORDER BY {_AT}), lambda a, c: a + c) AS total FROM b GROUP BY step),
p AS (SELECT lane, list_reduce(list(x / total ORDER BY step), lambda a, c: a + c) / count(*) AS planned FROM b JOIN t USING (step) GROUP BY lane)"""


@query("integrated_mixture", f"WITH {STAGE}, {ORDERED}, h AS (SELECT lane, CAST(headline AS DOUBLE) AS headline FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v})' for k, v in O.HEADLINE.items())}) AS t(lane, headline)) SELECT lane, round(planned, 4) AS planned, round(planned - headline, 4) AS drift, abs(planned - headline) > 0.03 AS out_of_tolerance FROM p JOIN h USING (lane)")
def integrated_mixture(spark, d):
    """Mean share of each lane over the steps.  Doubles are added in the order of the steps, so the order in which
    a shuffle brings them can't move a sum that lies at the edge of rounding."""
    head = spark.createDataFrame(list(O.HEADLINE.items()), "lane string, headline double")
    steps = F.array_sort(F.collect_list(F.struct("step", "share")))
    mean = F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s["share"]) / F.count("*")
    p = O.shares_table(spark, O.Schedule()).groupBy("lane").agg(mean.alias("planned")).join(head, "lane")
    drift = F.col("planned") - F.col("headline")
    return p.select("lane", F.round("planned", 4).alias("planned"), F.round(drift, 4).alias("drift"), (F.abs(drift) > O.DRIFT_TOLERANCE).alias("out_of_tolerance"))


@query("model_phase", "SELECT CAST(step AS INTEGER) AS step, CASE WHEN step / 80.0 < 0.25 THEN 'early' WHEN step / 80.0 < 0.60 THEN 'mid' WHEN step / 80.0 < 0.97 THEN 'late' ELSE 'anneal' END AS phase FROM range(0, 80) AS r(step)")
def model_phase(spark, d):
    p = F.col("id") / 80
    return spark.range(80).select(F.col("id").cast("int").alias("step"), F.when(p < 0.25, "early").when(p < 0.60, "mid").when(p < 0.97, "late").otherwise("anneal").alias("phase"))


@query("quota_per_step")
def quota_per_step(spark, d):
    """The allocator is recursive; tests hold its totals against known ones."""
    return O.quota_table(spark, O.Schedule())


@query("supply_verdict", "WITH s AS (SELECT source AS lane, CAST(sum(n_chars) AS DOUBLE) AS supply FROM documents GROUP BY source), w AS (SELECT 'src' || i AS lane, 50000.0 * (1 + i) AS want FROM range(0, 25) AS r(i)) SELECT lane, round(want / supply, 6) AS ratio, CASE WHEN supply IS NULL THEN 'must_synthesize' WHEN want / supply <= 1 THEN 'covered' WHEN want / supply <= 4 THEN 'needs_repetition' ELSE 'must_synthesize' END AS verdict FROM w LEFT JOIN s USING (lane)")
def supply_verdict(spark, d):
    """What lanes want against what sources hold; a lane without supply must be synthesised."""
    s = table(spark, d, "documents").groupBy(F.col("source").alias("lane")).agg(F.sum("n_chars").cast("double").alias("supply"))
    w = spark.range(25).select(F.concat(F.lit("src"), "id").alias("lane"), (F.lit(50000.0) * (1 + F.col("id"))).alias("want"))
    ratio = F.try_divide("want", "supply")
    verdict = F.when(ratio.isNull(), "must_synthesize").when(ratio <= 1, "covered").when(ratio <= 4, "needs_repetition").otherwise("must_synthesize")
    return w.join(s, "lane", "left").select("lane", F.round(ratio, 6).alias("ratio"), verdict.alias("verdict"))


@query("pool_stats", r"SELECT lang AS lane, count(*) AS units, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (doc_id % 33 = 0) AS reserved, count(*) FILTER (NOT doc_id % 33 = 0) AS eligible FROM documents GROUP BY lang")
def pool_stats(spark, d):
    """Units of a lane; reserved ones are not eligible before the last stage."""
    kept = F.col("doc_id") % 33 == 0
    return table(spark, d, "documents").groupBy(F.col("lang").alias("lane")).agg(F.count("*").alias("units"), F.sum("n_chars").alias("chars"), F.count_if(kept).alias("reserved"), F.count_if(~kept).alias("eligible"))


SCORES = "e AS (SELECT event_type AS lane, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq FROM events), c AS (SELECT lane, seq // 2 AS slot, CAST(seq % 2 AS INTEGER) AS cand, score, seq, lane IN ('error', 'signup') AND (seq // 2) % 3 = 0 AS floor, 100 + seq % 57 AS loss_tokens FROM e)"
THR = f"{SCORES}, f AS (SELECT *, quantile_cont(score, 0.6) OVER (PARTITION BY lane ORDER BY seq ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS p, count(*) OVER (PARTITION BY lane ORDER BY seq ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS n FROM c), t AS (SELECT lane, slot, CASE WHEN n >= 8 THEN p END AS thr FROM f WHERE cand = 0), r AS (SELECT c.*, thr FROM c JOIN t USING (lane, slot))"
DECIDED = f"{THR}, k AS (SELECT *, CASE WHEN thr IS NULL OR score >= thr THEN 'accepted' WHEN floor THEN 'protected' WHEN score >= thr * 0.85 THEN 'deferred' ELSE 'rejected' END AS status, CAST(floor(loss_tokens * CASE WHEN thr IS NULL OR thr = 0 THEN 1.0::DOUBLE ELSE least(2.0::DOUBLE, score / thr) END) AS BIGINT) AS effective FROM r)"


def scores(spark, d):
    e = numbered(table(spark, d, "events"), ["event_type"], ["event_id"]).withColumn("seq", F.col("i") - 1)
    slot = F.floor(F.col("seq") / 2)
    return e.select(
        F.col("event_type").alias("lane"), slot.alias("slot"), (F.col("seq") % 2).alias("cand"), F.col("value").alias("score"),
        (F.col("event_type").isin("error", "signup") & (slot % 3 == 0)).alias("floor"), (100 + F.col("seq") % 57).alias("loss_tokens"),
    )


@query("opus_threshold", f"WITH {THR} SELECT lane, slot, cand, round(thr, 6) AS thr FROM r")
def opus_threshold(spark, d):
    return O.thresholds(scores(spark, d)).select("lane", "slot", "cand", F.round("thr", 6).alias("thr"))


@query("opus_decide", f"WITH {DECIDED} SELECT lane, slot, cand, status, effective FROM k")
def opus_decide(spark, d):
    return O.decide(O.thresholds(scores(spark, d))).select("lane", "slot", "cand", "status", "effective")


@query("opus_winner", f"WITH {DECIDED} SELECT lane, slot, cand, NOT status IN ('accepted', 'protected') AS backfill FROM k QUALIFY row_number() OVER (PARTITION BY lane, slot ORDER BY (status IN ('accepted', 'protected')) DESC, CASE WHEN status IN ('accepted', 'protected') THEN cand END, score DESC, cand) = 1")
def opus_winner(spark, d):
    return O.winners(O.decide(O.thresholds(scores(spark, d)))).select("lane", "slot", "cand", "backfill")


@query("opus_rates", f"WITH {DECIDED} SELECT lane, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'protected') AS protected, count(*) FILTER (status = 'deferred') AS deferred, count(*) FILTER (status = 'rejected') AS rejected, round(count(*) FILTER (status IN ('deferred', 'rejected'))::DOUBLE / count(*), 6) AS rejection_rate FROM k GROUP BY lane")
def opus_rates(spark, d):
    states = ["accepted", "protected", "deferred", "rejected"]
    t = O.decide(O.thresholds(scores(spark, d))).groupBy("lane").pivot("status", states).count().na.fill(0, states)
    total = sum(F.col(s) for s in states)
    # as SQL rounds a double: the product with a million, not its decimal digits, which at a half can go the other way
    rate = F.round((F.col("deferred") + F.col("rejected")) / total * 1e6) / 1e6
    return t.select("lane", *states, rate.alias("rejection_rate"))
