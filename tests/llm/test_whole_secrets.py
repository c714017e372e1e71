"""Unlabelled secrets of any length are linked and masked."""

from __future__ import annotations

import pytest

from millrace.llm import secretscan


@pytest.mark.parametrize("length", [12, 64, 65, 88, 5000])
def test_long_unlabelled_key_is_masked(spark, length):
    key = ("aB3+/" * length)[:length - 2] + "=="
    df = spark.createDataFrame([(1, f"client_id=abc123 {key} end"), (2, f"no identifier {key} end")], "doc_id long, text string")
    found = secretscan.scan(spark, df, keep=["doc_id", "text"])
    assert {r["doc_id"]: r["text"] for r in secretscan.redact(found).collect()} == {1: "[SECRET] [SECRET] end", 2: f"no identifier {key} end"}
