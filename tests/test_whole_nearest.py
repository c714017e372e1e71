"""nearest_label_rate asks for every vector: against plain Python, and its SQL on odd rows without ties."""

from __future__ import annotations

import math
import random

import duckdb
import pytest

from millrace.operators import codecs
from millrace.plans.registry import oracle_sql, queries

KIND = "vec_id long, embedding array<float>, label int"


def regular(n):
    return [(i * 7 + 1, [math.sin(i * 1.7 + j * j) for j in range(5)], i * i % 3) for i in range(n)]


def odd():
    """Nulls in every place, other lengths, what is not finite, copies and repeated ids; no ties between labels."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], i * i % 3 if i % 13 else None) for i in range(120)]
    rows += [(200 + i, [rng.uniform(-1, 1) if (i + j) % 4 else None for j in range(6)], i % 3) for i in range(20)]
    rows += [(300 + i, [rng.uniform(-1, 1) for _ in range(1 + i % 9)], i % 3) for i in range(20)]
    rows += [(400, None, 1), (401, [], 1), (402, [None] * 6, 1), (None, [0.1] * 6, 1), (403, [0.25] * 6, None)]
    rows += [(500, [math.inf, 0.5, 0.5, 0.5, 0.5, 0.5], 2), (501, [3e38] * 6, 1), (502, [-0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (503, [0.0] * 6, 1)]
    rows += [(600 + i, [0.75] * 6, 2) for i in range(9)] + [(700, [0.9] * 6, None), (700, [0.3] * 6, None), (701, [0.31] * 6, 2)]
    rows += [(800 + i, [2.0] * 6, None) for i in range(9)] + [(810, [2.0] * 6, 0)] + [(1, [5.0] * 6, 1), (1, [5.0] * 6, 1)]
    return rows


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def sql(d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    return con.sql(oracle_sql()["nearest_label_rate"]).fetchall()[0]


def got(spark, d):
    return tuple(queries()["nearest_label_rate"](spark, d).select("queries", "same_label").first())


@pytest.mark.parametrize("block", [2048, 7])
def test_every_vector_asks(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr("millrace.operators.codecs.WIDE", block)
    rows = regular(60)
    same = 0
    for i, u, label in rows:
        same += min((sum((x - y) ** 2 for x, y in zip(u, w)), m) for j, w, m in rows if j != i)[1] == label
    d = table(spark, tmp_path, rows)
    assert 0 < same < 60
    assert got(spark, d) == (60, same)
    assert sql(d) == (60, same)


@pytest.mark.parametrize("block", [2048, 64, 10])
def test_odd_rows_as_in_sql(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr("millrace.operators.codecs.WIDE", block)
    d = table(spark, tmp_path, odd())
    assert got(spark, d) == sql(d)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    of_all = oracle_sql()["nearest_label_rate"].split(" SELECT count(*) AS queries")[0] + ", x AS (SELECT vec_id, min(dist) FILTER (lb IS NOT NULL) AS least FROM p GROUP BY vec_id) SELECT vec_id, lb, least FROM m JOIN x USING (vec_id)"
    want = {i: (lb, least) for i, lb, least in con.sql(of_all).fetchall()}
    found = {r["query_id"]: (r["nearest_label"], r["value"]) for r in codecs.nearest_labels(spark.read.parquet(f"{d}/embeddings.parquet"), "embedding").collect()}
    assert {k: str(v) for k, v in found.items()} == {k: str(v) for k, v in want.items()}


@pytest.mark.parametrize("rows", [[], regular(1), [(1, [1.0], 1), (1, [2.0], 1)], [(1, [1.0], None), (2, [2.0], None)], [(1, None, 1), (2, None, 1)]])
def test_few_rows_as_in_sql(spark, tmp_path, rows):
    d = table(spark, tmp_path, rows)
    assert got(spark, d) == sql(d)


def test_of_equally_near_ones_the_least_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("millrace.operators.codecs.WIDE", 16)
    rows = [(i, [float(i % 2), 0.5], i % 5) for i in range(60)]
    found = {r["query_id"]: r["nearest"] for r in codecs.nearest_labels(spark.createDataFrame(rows, KIND), "embedding").collect()}
    assert found == {i: i % 2 if i > 1 else i + 2 for i in range(60)}
