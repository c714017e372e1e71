"""Vector queries look at all pairs: against plain Python."""

from __future__ import annotations

import math
from itertools import combinations

import pytest

from millrace.plans.registry import queries


@pytest.fixture(params=["made", "table"])
def data(request, spark, sf, tmp_path):
    if request.param == "table":
        return sf
    rows = [(i * 7 + 1, [math.sin(i * 1.7 + j * j) for j in range(5)], None if i % 11 == 3 else i % 4) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def pairs(spark, data):
    """(same label or None, cosine) of every pair."""
    rows = [(r["label"], [x / math.sqrt(sum(y * y for y in r["embedding"])) for x in r["embedding"]]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    return [(None if a is None or b is None else a == b, sum(x * y for x, y in zip(u, v))) for (a, u), (b, v) in combinations(rows, 2)]


def test_family_distance_is_over_all_pairs(spark, data):
    want: dict = {}
    for same, c in pairs(spark, data):
        want.setdefault(same, []).append(c)
    got = {r["same"]: (r["pairs"], r["cosine"]) for r in queries()["family_distance"](spark, data).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(abs(c - sum(want[k]) / len(want[k])) < 1.5e-6 for k, (_, c) in got.items())


@pytest.mark.parametrize("block", [1024, 7])
def test_relatedness_is_over_all_pairs(spark, data, block, monkeypatch):
    monkeypatch.setattr("millrace.operators.codecs.BLOCK", block)
    known = [(s, c) for s, c in pairs(spark, data) if s is not None]
    got = queries()["relatedness"](spark, data).first()
    assert abs(got["least_related"] - min(c for s, c in known if s)) < 1.5e-6
    assert abs(got["most_unrelated"] - max(c for s, c in known if not s)) < 1.5e-6
