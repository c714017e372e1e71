"""Scores that lie at their threshold are judged as in SQL, to the last bit of a double."""

from __future__ import annotations

import math

import duckdb
import pytest

from millrace.plans.registry import oracle_sql, queries


def at_the_edge(n: int = 60) -> list[tuple[float, float, float]]:
    """(low, high, score): 0.6 of eight scores lies between the fifth, low, and the sixth, high; score is that value, which
    one rounding of the sum and two put on different sides."""
    part, found = 7 * 0.6 - 4, []
    for low in range(1000, 9000, 7):
        for high in range(low + 5, low + 400, 35):
            a, b, score = low / 100, high / 100, (4 * low + high) // 5 / 100
            if (score >= math.fma(a, 1 - part, b * part)) != (score >= (5 - 7 * 0.6) * a + part * b):
                found.append((a, b, score))
    return found[:: len(found) // n]


@pytest.mark.parametrize("name", ["opus_decide", "opus_rates", "opus_winner"])
def test_scores_at_their_threshold(spark, tmp_path, name):
    rows = []
    for k, (low, high, score) in enumerate(at_the_edge()):
        for value in (0.0, 0.5, 1.0, 1.5, low, high, 500.0, 600.0, score, 700.0, None, score):
            rows.append((len(rows), f"type{k}", value))
    assert len(rows) >= 720
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want.fetchall()), key=str)


def test_rates_at_halves_are_rounded_as_in_sql(spark, tmp_path):
    """41 of 640 is 0.0640625, of which a double's product with a million lies below the half."""
    rows = [(i, "view", 0.0 if 0 < i < 616 and i % 15 == 0 else 1.0) for i in range(640)]
    assert sum(r[2] == 0.0 for r in rows) == 41
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(oracle_sql()["opus_rates"])
    assert {r[want.columns.index("rejection_rate")] for r in want.fetchall()} == {0.064062}
    got = queries()["opus_rates"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
