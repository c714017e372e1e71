"""Units, placements, positions and masks of packed sequences, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shortest tail window, fewest tokens of a unit, most placements of a sequence, policies by lane.
MIN_TAIL, MIN_UNIT, MAX_PLACEMENTS = 32, 8, 8
POLICIES = {"general_web": "concat_chop", "indic": "concat_chop", "code": "best_fit", "stem_math": "structure_preserving", "reasoning": "structure_preserving", "agentic": "structure_preserving", "long_context": "long_context"}


def window_units(shards: DataFrame, seq_len: int) -> DataFrame:
    """(shard, a, b): windows of a shard's (shard, n_tokens) stream; tails below MIN_TAIL go."""
    starts = shards.where("n_tokens > 0").select("shard", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n_tokens").cast("int") - 1, F.lit(seq_len))).alias("a"))
    cut = starts.withColumn("b", F.least(F.col("n_tokens").cast("int"), F.col("a") + seq_len))
    return cut.where((F.col("b") - F.col("a") == seq_len) | (F.col("b") - F.col("a") >= MIN_TAIL)).select("shard", "a", "b")


def turn_units(turns: DataFrame, seq_len: int) -> DataFrame:
    """(sample, turn, a, b): a unit for each target turn of (sample, turn, is_target, n): the turn, cut
    to seq_len, with as much of what is before it in the sample as there is room for."""
    run = Window.partitionBy("sample").orderBy("turn")
    at = turns.withColumn("end", F.sum("n").over(run)).withColumn("start", F.col("end") - F.col("n"))
    cut = at.where("is_target").withColumn("stop", F.least("end", F.col("start") + seq_len))
    room = F.lit(seq_len) - (F.col("stop") - F.col("start"))
    units = cut.withColumn("a", F.greatest(F.lit(0), F.col("start") - room))
    return units.where(F.col("stop") - F.col("a") >= MIN_UNIT).select("sample", "turn", "a", F.col("stop").alias("b"))


def place_in_order(units: DataFrame, seq_len: int) -> DataFrame:
    """Placements of (seq, unit, n) in unit order: a unit that crosses the end is cut there, later ones go."""
    run = Window.partitionBy("seq").orderBy("unit")
    end = units.withColumn("end", F.sum("n").over(run)).withColumn("dst_a", F.col("end") - F.col("n"))
    kept = end.where(F.col("dst_a") < seq_len)
    return kept.withColumns({"dst_b": F.least("end", F.lit(seq_len)), "segment_id": F.row_number().over(run) - 1}).select("seq", "unit", "segment_id", "dst_a", "dst_b")


def fill_whole(units: DataFrame, seq_len: int, order: str = "unit", most: int = MAX_PLACEMENTS) -> DataFrame:
    """Whole units only: in order, each that still fits goes in, at most `most` of them.

    A fold over the sequence's few candidates; no Python."""
    key = {"unit": F.struct(F.lit(0).alias("k"), "unit", "n"), "size": F.struct((-F.col("n")).alias("k"), "unit", "n")}[order]
    listed = units.groupBy("seq").agg(F.sort_array(F.collect_list(key)).alias("u"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<unit:long,a:long,b:long>>").alias("in"))
    folded = F.aggregate("u", empty, lambda acc, x: F.when(
        (acc["used"] + x["n"] <= seq_len) & (F.size(acc["in"]) < most),
        F.struct((acc["used"] + x["n"]).alias("used"), F.concat(acc["in"], F.array(F.struct(x["unit"].alias("unit"), acc["used"].alias("a"), (acc["used"] + x["n"]).alias("b")))).alias("in")),
    ).otherwise(acc))
    return listed.select("seq", F.posexplode(folded["in"]).alias("segment_id", "p")).select("seq", "segment_id", F.col("p.unit").alias("unit"), F.col("p.a").alias("dst_a"), F.col("p.b").alias("dst_b"))


def positions(tokens: DataFrame) -> DataFrame:
    """Adds position_id and loss_mask to (seq, pos, segment_id, is_target): positions restart with every
    segment; a position bears loss if the next token is a target of the same segment."""
    w = Window.partitionBy("seq").orderBy("pos")
    s = Window.partitionBy("seq", "segment_id").orderBy("pos")
    bears = F.lead("is_target").over(w) & (F.lead("segment_id").over(w) == F.col("segment_id")) & (F.col("segment_id") >= 0)
    return tokens.withColumns({"position_id": F.row_number().over(s) - 1, "loss_mask": F.coalesce(bears, F.lit(False))})


def visible_pairs(tokens: DataFrame) -> DataFrame:
    """How many pairs of each sequence attention may see: earlier or same, same segment, no padding.

    Counted from segment lengths, not from pairs."""
    n = tokens.where("segment_id >= 0").groupBy("seq", "segment_id").agg(F.count("*").alias("n"))
    return n.groupBy("seq").agg(F.sum(F.expr("n * (n + 1) div 2")).alias("visible"))


def batch_stats(placed: DataFrame) -> DataFrame:
    """Totals of (seq, segment_id, is_target, loss_mask) rows."""
    used = F.col("segment_id") >= 0
    return placed.agg(
        F.count("*").alias("positions"), F.count_if(~used).alias("pad_positions"), F.count_if(used).alias("used_positions"), F.count_if("loss_mask").alias("loss_bearing"),
        F.count_if(used & ~F.col("loss_mask")).alias("context_positions"), F.round(F.count_if(used) / F.count("*"), 6).alias("utilization"),
        F.countDistinct(F.when(used, F.struct("seq", "segment_id"))).alias("segments"),
    )


_POLICIES: dict = {}


def register_policy(name: str, policy) -> None:
    """A policy takes (units, seq_len) and returns placements."""
    _POLICIES[name] = policy


def policy(name: str):
    return _POLICIES[name]


register_policy("pad_only", lambda u, n: place_in_order(u.where("unit % 8 = 0"), n))
register_policy("concat_chop", place_in_order)
register_policy("long_context", lambda u, n: place_in_order(u.where("unit % 8 = 0"), n))
register_policy("structure_preserving", lambda u, n: fill_whole(u, n, "unit"))
register_policy("greedy", lambda u, n: fill_whole(u, n, "unit"))
register_policy("best_fit", lambda u, n: fill_whole(u, n, "size"))
