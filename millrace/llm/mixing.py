"""Mixing sources to target weights by capped water-filling.

Every source gets its weight's share of all words.  What a source can't give
within its most epochs is shared among the others by weight, until none is above
its cap.  A source is then repeated whole as often as its target holds it, and a
seeded order of its documents gives the fractional repetition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one bucket of the seeded order holds, about.
BUCKET_ROWS = 4000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    Sources by code point, null last, have the weights in turn.  With sources ordered by
    cap/weight, the level is the first (total - caps before) / (weights from here on) that
    does not exceed the source's own cap/weight; sources before are at their caps."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    weighted = by_source.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward)
    ranked = weighted.withColumns({"rank": F.row_number().over(fill), "level": level})
    ranked = ranked.withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    chosen = ranked.withColumn("first", F.min(F.when(F.col("fits"), F.struct("rank", "level"))).over(everything))
    return chosen.select(
        "source", "source_size",
        F.when(F.col("rank") < F.col("first.rank"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.level")).alias("target"),
    )


def mix(spark: SparkSession, docs: DataFrame, weights: list[int], max_epochs: int = 3, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """keep columns, size, source_size, target and taken of every row of docs (doc_id, text, source).  Columns of keep
    with one of these four names give way; others may have any name.

    taken is in words, repeats counted: the size times the whole repetitions of the source,
    plus what the fractional repetition takes; it takes documents in the order of
    md5(seed|doc_id) until the source's target is met exactly, the last one in part.  No
    document exceeds max_epochs times its size.  Null and empty texts have size 0 and take 0;
    the null source is a source; rows with equal or null doc_id are documents of their own.
    An empty table gives no rows.  Running sums go by buckets of the order, so a hot source
    is summed by many tasks."""
    keep = [c for c in keep or ["doc_id"] if c.lower() not in ("size", "source_size", "target", "taken")]
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    tie = F.xxhash64(F.col("text")) if "text" in keep else F.lit(0)
    held = docs.select(
        F.struct(*keep).alias("kept"), F.col("source").cast("string").alias("source"), F.col("doc_id").alias("order_id"),
        words(F.col("text").cast("string")).alias("size"), mark.alias("mark"), tie.alias("tie"),
    ).withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # never null: plain keys for join and window alike
    if "text" not in keep:
        held = materialize(spark, held, "sizes")
    digits = max(1, math.ceil(math.log(max(1, held.count()) / BUCKET_ROWS, 16)))
    held = held.withColumn("bucket", F.substring("mark", 1, digits))
    buckets = held.groupBy("named", "source", "bucket").agg(F.sum("size").alias("size"))
    buckets = materialize(spark, buckets, "buckets")
    wanted = targets(buckets, weights, max_epochs).withColumn("words", F.round("target").cast("long"))
    run = Window.partitionBy("named").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).drop("size").alias("b")
    starts = starts.join(wanted.alias("w"), F.expr("b.source <=> w.source")).select("named", "bucket", "before", "source_size", "target", "words")
    joined = held.join(starts, ["named", "bucket"])
    inside = Window.partitionBy("named", "bucket").orderBy("mark", "order_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - whole * F.col("source_size") - passed))
    return joined.withColumns({"whole": whole, "extra": extra}).select(
        "kept.*", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken")
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as rows: each document (with text) as often as it is taken; a part is its first words."""
    some = mixed.where("taken > 0").withColumn("copy", F.explode(F.expr("sequence(0L, (taken - 1) div size)")))
    left = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(left, F.lit(1)).cast("int")), " ")
    text = F.when(left < F.col("size"), part).otherwise(F.col("text"))
    made = some.withColumn("text", text)
    if "n_chars" in columns:
        made = made.withColumn("n_chars", F.length("text").cast("long"))
    return made.select(*columns)
