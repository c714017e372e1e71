"""Curriculum mixtures: stages, blended shares, per-step quotas; candidate selection."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.runs import in_blocks

#: Lanes in tie-break order, headline shares, floors, and the stages' fraction, warmup and shares by lane.
LANES = ["general_web", "code", "indic", "stem_math", "reasoning", "long_context", "agentic"]
HEADLINE = dict(zip(LANES, [0.34, 0.24, 0.16, 0.12, 0.06, 0.06, 0.02], strict=True))
FLOORS = {"indic": 0.12, "reasoning": 0.04, "agentic": 0.02}
STAGES = [
    ("0-seed", 0.05, 0.00, [0.68, 0.08, 0.16, 0.02, 0.04, 0.00, 0.02]),
    ("1-general-foundation", 0.45, 0.15, [0.44, 0.22, 0.17, 0.08, 0.04, 0.03, 0.02]),
    ("2-capability-ramp", 0.32, 0.15, [0.18, 0.32, 0.15, 0.19, 0.08, 0.04, 0.04]),
    ("3-long-context", 0.15, 0.20, [0.14, 0.16, 0.14, 0.10, 0.08, 0.34, 0.04]),
    ("4-anneal", 0.03, 0.10, [0.08, 0.20, 0.28, 0.10, 0.18, 0.08, 0.08]),
]
FLOOR_WINDOW, DRIFT_TOLERANCE = 10, 0.03
KEEP_PERCENTILE, BUFFER, WARM, DEFER_BAND = 0.60, 64, 8, 0.85


@dataclass
class Schedule:
    """A plan of n_steps steps; everything here is a few numbers a step, computed on the driver."""

    n_steps: int = 80
    per_step: int = 8
    stages: list = field(default_factory=lambda: STAGES)

    def __post_init__(self) -> None:
        at, rows = 0, []
        for i, (name, share, warm, mix) in enumerate(self.stages):
            size = max(1, round(share * self.n_steps))
            end = self.n_steps if i == len(self.stages) - 1 else min(self.n_steps, at + size)
            rows.append({"stage": name, "step_start": at, "step_end": end, "warmup_steps": round(warm * (end - at)), "mix": mix})
            at = end
        self.compiled = rows

    def stage_at(self, step: int) -> int:
        return next((i for i, r in enumerate(self.compiled) if r["step_start"] <= step < r["step_end"]), len(self.compiled) - 1)

    def shares(self, step: int) -> list[float]:
        """Lane shares; within a warmup, blended with the stage before."""
        i = self.stage_at(step)
        now, mix = self.compiled[i], list(self.compiled[i]["mix"])
        into = step - now["step_start"]
        if i and into < now["warmup_steps"]:
            a = (into + 1) / (now["warmup_steps"] + 1)
            mix = [(1 - a) * x + a * y for x, y in zip(self.compiled[i - 1]["mix"], mix, strict=True)]
        total = sum(mix)
        return [x / total for x in mix]

    def quotas(self) -> list[dict[str, int]]:
        """Slots of each lane in each step: each slot goes to a lane that owes its floor, else to the
        largest deficit of what was planned so far; ties by lane order."""
        n, done, target = len(LANES), [0] * len(LANES), [0.0] * len(LANES)
        past: list[list[int]] = []
        out = []
        for step in range(self.n_steps):
            share = self.shares(step)
            target = [t + s * self.per_step for t, s in zip(target, share, strict=True)]
            span = min(FLOOR_WINDOW, step + 1)
            recent = [sum(row[k] for row in past[len(past) - span + 1:]) if span > 1 else 0 for k in range(n)]
            debt = [min(self.per_step, max(0, math.ceil(FLOORS.get(lane, 0) * span * self.per_step) - recent[k])) for k, lane in enumerate(LANES)]
            got = [0] * n
            for _ in range(self.per_step):
                open_lanes = [k for k in range(n) if share[k] > 0 or got[k] < debt[k]]
                best = max(open_lanes, key=lambda k: (got[k] < debt[k], round(target[k] - done[k] - got[k], 9), -k))
                got[best] += 1
            done = [a + b for a, b in zip(done, got, strict=True)]
            past.append(got)
            out.append({"step": step, "floor": {LANES[k]: min(debt[k], got[k]) for k in range(n)}, "quota": {LANES[k]: got[k] for k in range(n)}})
        return out


def quota_table(spark: SparkSession, schedule: Schedule) -> DataFrame:
    rows = [(q["step"], lane, q["quota"][lane], q["floor"][lane]) for q in schedule.quotas() for lane in LANES]
    return spark.createDataFrame(rows, "step int, lane string, quota int, floor_slots int")


def stage_table(spark: SparkSession, schedule: Schedule) -> DataFrame:
    rows = [(r["stage"], r["step_start"], r["step_end"], r["warmup_steps"]) for r in schedule.compiled]
    return spark.createDataFrame(rows, "stage string, step_start int, step_end int, warmup_steps int")


def shares_table(spark: SparkSession, schedule: Schedule) -> DataFrame:
    """(step, lane, share), by a range join of steps with stages and a blend with the stage before."""
    mix = spark.createDataFrame([(i, k, lane, float(r["mix"][k])) for i, r in enumerate(schedule.compiled) for k, lane in enumerate(LANES)], "i int, k int, lane string, x double")
    st = spark.createDataFrame([(i, r["step_start"], r["step_end"], r["warmup_steps"]) for i, r in enumerate(schedule.compiled)], "i int, a int, b int, w int")
    steps = spark.range(schedule.n_steps).select(F.col("id").cast("int").alias("step"))
    at = steps.join(st, F.expr("step >= a AND step < b")).join(mix, "i").join(mix.select((F.col("i") + 1).alias("i"), "lane", F.col("x").alias("prev")), ["i", "lane"], "left")
    warm = (F.col("i") > 0) & (F.col("step") - F.col("a") < F.col("w"))
    a = (F.col("step") - F.col("a") + 1) / (F.col("w") + 1)
    raw = at.withColumn("raw", F.when(warm, (1 - a) * F.col("prev") + a * F.col("x")).otherwise(F.col("x")))
    every = Window.partitionBy("step").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the lanes' order
    return raw.select("step", "lane", (F.col("raw") / F.sum("raw").over(every)).alias("share"))


def quantile(values: str, q: float) -> Column:
    """The quantile q of a sorted array of doubles, between two values by their weights, as SQL's quantile_cont has it
    to the last bit: the lower value's product and the sum are rounded once.  F.percentile rounds them twice, and a
    score that lies at a threshold is then judged otherwise."""
    at = (F.size(values) - 1) * F.lit(q)
    part = at - F.floor(at)
    low, high = (F.get(values, i.cast("int")).cast("double") for i in (F.floor(at), F.ceil(at)))
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")
    return F.when((part > 0) & low.isNotNull(), fused).otherwise(low)


def thresholds(scores: DataFrame, by: str = "lane") -> DataFrame:
    """Adds thr to (slot, cand, score): the keep percentile of the last BUFFER scores of earlier slots;
    null until WARM are seen.  Two candidates of a slot share a threshold."""
    seen = in_blocks(scores.withColumn("seq", F.col("slot") * 2 + F.col("cand") + 1), "seq", back=BUFFER)
    frame = Window.partitionBy(by, "block").orderBy("seq").rowsBetween(-BUFFER, -1)
    past = seen.withColumns({"past": F.collect_list("score").over(frame), "n": F.count("*").over(frame)}).where("own")
    # a slot's two candidates lie next to each other in one block; both take what the first one sees
    first = past.withColumn("past", F.when((F.col("cand") == 0) & (F.col("n") >= WARM), F.sort_array("past")))
    pair = Window.partitionBy(by, "block").orderBy("seq")
    both = first.withColumn("p", quantile("past", KEEP_PERCENTILE)).withColumn("thr", F.when(F.col("cand") == 0, F.col("p")).otherwise(F.lag("p").over(pair)))
    return both.drop("p", "past", "n", "block", "own")


def decide(rows: DataFrame) -> DataFrame:
    """Adds status, reason and effective tokens to (score, thr, floor, loss_tokens)."""
    ok = F.col("thr").isNull() | (F.col("score") >= F.col("thr"))
    status = F.when(ok, "accepted").when(F.col("floor"), "protected").when(F.col("score") >= F.col("thr") * DEFER_BAND, "deferred").otherwise("rejected")
    factor = F.when(F.col("thr").isNull() | (F.col("thr") == 0), F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.try_divide("score", "thr")))
    return rows.withColumn("status", status).withColumns({
        "reason": F.when(F.col("status") == "protected", "protected_floor_override").when(F.col("status") == "deferred", "below_threshold_scarce_lane").when(F.col("status") == "rejected", "low_proxy_utility"),
        "effective": F.floor(F.col("loss_tokens") * factor).cast("long"),
    })


def winners(decided: DataFrame, by: str = "lane") -> DataFrame:
    """One candidate of each slot: the first accepted or protected, else the best score, as backfill."""
    ok = F.col("status").isin("accepted", "protected")
    order = Window.partitionBy(by, "slot").orderBy(ok.desc(), F.when(ok, F.col("cand")), F.col("score").desc(), "cand")
    return decided.withColumns({"r_": F.row_number().over(order), "backfill": ~ok}).where("r_ = 1").drop("r_")
