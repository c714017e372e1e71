"""Packed sequences hold every word of a conversation: against plain Python over the whole texts."""

from __future__ import annotations

import pytest

from millrace.plans.registry import queries

LONG = 700


def write(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(params=["made", "table"])
def data(request, spark, sf, tmp_path):
    if request.param == "table":
        return sf
    return write(spark, tmp_path, [
        (3, 0, "user", "a " * 20), (3, 1, "assistant", "b " * LONG), (3, 2, "user", " "), (3, 3, "assistant", "c"),
        (4, 0, "user", "a " * 255), (4, 1, "assistant", "b"), (5, 0, "user", "x"), (6, 0, "user", ""),
    ])


def expected(spark, data):
    """{(seq, pos): (segment, is_target)} of windows of 256, padded to their end."""
    texts: dict[int, list] = {}
    for r in sorted(spark.read.parquet(f"{data}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        texts.setdefault(r["conv_id"], []).extend((r["turn"] // 2, r["role"] == "assistant") for _ in r["text"].split())
    out = {}
    for conv, words in texts.items():
        words += [(-1, False)] * (-len(words) % 256)
        out |= {((conv << 24) + i // 256, i % 256): w for i, w in enumerate(words)}
    return out


def test_every_word_has_its_position(spark, data):
    want = expected(spark, data)
    rows = queries()["pack_positions"](spark, data).collect()
    assert len(rows) == len(want)
    assert {(r["seq"], r["pos"]): r["segment_id"] for r in rows} == {k: s for k, (s, _) in want.items()}
    first: dict = {}
    for r in sorted(rows, key=lambda r: (r["seq"], r["pos"])):
        assert r["position_id"] == r["pos"] - first.setdefault((r["seq"], r["segment_id"]), r["pos"])


def test_totals_are_those_of_the_whole_texts(spark, data):
    want = expected(spark, data)
    bears = {k for k, (s, _) in want.items() if s >= 0 and (n := want.get((k[0], k[1] + 1))) and n[1] and n[0] == s}
    q = queries()
    stats = q["batch_stats"](spark, data).first()
    used = sum(s >= 0 for s, _ in want.values())
    assert (stats["positions"], stats["used_positions"], stats["loss_bearing"]) == (len(want), used, len(bears))
    masks = {r["seq"]: (r["positions"], r["loss_bearing"], r["checksum"]) for r in q["loss_mask"](spark, data).collect()}
    assert masks == {s: (256, sum(k[0] == s for k in bears), sum(p for t, p in bears if t == s)) for s in {s for s, _ in want}}
    assert set(q["mask_audit"](spark, data).first()) == {0}
    n: dict = {}
    for (seq, _), (s, _) in want.items():
        if s >= 0:
            n[seq, s] = n.get((seq, s), 0) + 1
    visible: dict = {}
    for (seq, _), k in n.items():
        visible[seq] = visible.get(seq, 0) + k * (k + 1) // 2
    assert {r["seq"]: r["visible"] for r in q["attention_pairs"](spark, data).collect()} == visible
    assert all(r["passed"] for r in q["evidence_packing"](spark, data).collect())
    segments, context = {}, {}
    for (seq, p), (s, _) in want.items():
        if s >= 0:
            segments.setdefault(seq, set()).add(s)
            context[seq] = context.get(seq, 0) + ((seq, p) not in bears)
    got = q["batch_anatomy"](spark, data).first()
    assert got["most_segments"] == max(segments, key=lambda s: (len(segments[s]), -s))
    assert got["most_context"] == max(context, key=lambda s: (context[s], -s))
