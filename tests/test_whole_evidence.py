"""Lists are reconciled and batched over all documents: against plain Python."""

from __future__ import annotations

from millrace.plans.registry import queries


def test_all_documents_are_reconciled_and_batched(spark, sf):
    docs = {r["doc_id"]: len(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"] + 30: len(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert max(docs) >= 60 and any(i % 5 for i in docs)
    want = {i: "missing_right" if i not in items else "missing_left" if i not in docs else "differs" if docs[i] != items[i] else "same" for i in docs | items}
    rows = queries()["reconcile_lists"](spark, sf).collect()
    assert len(rows) == len(want) and {r["id"]: r["finding"] for r in rows} == want
    ids = sorted(docs)
    cuts = [ids[i:i + 12] for i in range(0, len(ids), 12)]
    assert sorted(tuple(r) for r in queries()["fetch_batches"](spark, sf).select("batch", "ids", "first_id").collect()) == [(i, len(c), c[0]) for i, c in enumerate(cuts)]
