"""Running numbers, running sums and short frames over long series, without one task for a whole series.

A window over a series puts the series into one task, however long it is.  Here rows are dealt by
ranges of their order; what lies before a range comes from totals of the ranges, of which there are
as many as shuffle partitions; and a frame of a few rows needs a few rows of the block before, no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import cut

#: Rows of a block of a series.
BLOCK = 8192


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "i", add: str | None = None) -> DataFrame:
    """Adds name: the row's number (from 1) in its group's order, or the running sum of add up to and with it.

    order must tell rows apart, or equal ones are numbered in any order.  Groups may be of any size, one
    included; by may be empty.  An empty table stays empty."""
    ranged = df.repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id())
    ranged = cut(ranged, "ranges")  # ranges are sampled; written, they are the same for both reads
    value = F.count("*") if add is None else F.sum(add)
    totals = ranged.groupBy(*by, "range_").agg(value.alias("total_"))
    before = F.sum("total_").over(Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*[F.col(c).alias(f"by{k}_") for k, c in enumerate(by)], F.col("range_").alias("at_"), F.coalesce(before, F.lit(0)).alias("before_"))
    own = Window.partitionBy(*by, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.withColumn("run_", F.count("*").over(own) if add is None else F.sum(add).over(own))
    same = F.col("range_") == F.col("at_")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"by{k}_"))
    joined = run.join(offsets if by else F.broadcast(offsets), same)  # without groups, a row for each shuffle partition
    return joined.select(*df.columns, (F.col("before_") + F.col("run_")).alias(name))


def in_blocks(df: DataFrame, i: str = "i", back: int = 0, ahead: int = 0) -> DataFrame:
    """Adds block, and own: rows in blocks of BLOCK consecutive numbers, with copies (not own) of the back rows before
    a block and of the ahead rows after it, so that frames of that reach are whole within a block."""
    at = F.col(i) - 1
    block, place = F.floor(at / BLOCK), at % BLOCK
    blocks = F.array_compact(F.array(block, F.when(place >= BLOCK - back, block + 1), F.when(place < ahead, block - 1)))
    return df.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == block)
