"""Queries are copied for every block of vectors; the copies don't go through the driver, nor many at once to Python."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import codecs
from millrace.plans.registry import queries


@pytest.mark.parametrize("name", ["nearest_label_rate", "nearest_neighbor"])
def test_copies_are_not_broadcast(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr("millrace.operators.codecs.BLOCK", 8)
    rows = [(i, [math.sin(i * 1.7 + j * j) for j in range(8)], i % 3) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries()[name](spark, str(tmp_path))
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "MapInPandas" in plan
    assert "Broadcast" not in plan


def test_batches_of_blocks_are_bounded_in_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    vectors = spark.range(5000).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.array_repeat(F.col("id").cast("double"), 256).alias("u"))
    dealt, n = codecs._blocks(vectors, "u")
    assert n == 5

    def measured(batches):
        for b in batches:
            yield pd.DataFrame({"rows": [len(b)], "bytes": [sum(8 * (len(x) + len(y)) for x, y in zip(b["v_a"], b["v_b"], strict=True))]})

    met = codecs._meet(dealt, dealt, F.col("block"), F.lit(n - 1)).coalesce(1)
    got = met.mapInPandas(measured, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 15
    largest_row = 2 * 8 * 256 * 1200
    assert max(r["bytes"] for r in got) <= codecs.BATCH_BYTES + largest_row
