"""Numbers, sums and frames dealt by ranges and blocks, against plain Python."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import runs


@pytest.mark.parametrize("n", [0, 1, 57])
def test_numbers_and_sums(spark, n):
    rows = [("a" if i % 3 else None, (i * 37) % 101, i) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r["g"], r["k"]): (r["i"], r["s"]) for r in runs.numbered(runs.numbered(df, ["g"], ["k"]), ["g"], [F.col("k").desc()], "s", add="v").collect()}
    assert len(got) == n
    for g in ("a", None):
        mine = sorted((k, v) for x, k, v in rows if x == g)
        for i, (k, _) in enumerate(mine):
            assert got[g, k] == (i + 1, sum(v for _, v in mine[i:]))
    assert sorted(r["i"] for r in runs.numbered(df, [], ["k"]).collect()) == list(range(1, n + 1))


def test_frames_are_whole_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 8)
    df = runs.numbered(spark.range(50).select((F.col("id") % 2).alias("g"), "id"), ["g"], ["id"])
    blocks = runs.in_blocks(df, back=3, ahead=2)
    w = Window.partitionBy("g", "block").orderBy("i")
    got = blocks.select("g", "i", "own", F.collect_list("i").over(w.rowsBetween(-3, 2)).alias("near")).where("own").collect()
    by = defaultdict(dict)
    for r in got:
        by[r["g"]][r["i"]] = r["near"]
    for g in (0, 1):
        assert by[g] == {i: [x for x in range(i - 3, i + 3) if 1 <= x <= 25] for i in range(1, 26)}
