"""Operators against plain Python, on rows made for the rules."""

from __future__ import annotations

import os
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import adapters, codecs, dedup, firewall, mixture, packing, shards, vocabulary
from millrace.operators import ledger as L
from millrace.sources import paged
from millrace.sources.tables import require_columns, table, with_defaults
from millrace.streaming import windows as W


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_normalize_keeps_joiners_and_drops_noise(spark):
    raw = "  अ‌आ&amp;​﻿\t\tx\n\n\n\ny\x07  "
    assert one(spark, raw, T.normalize) == "अ‌आ& x\n\ny"
    assert one(spark, raw, T.garbage) == 3
    assert one(spark, "a&#8203;b", T.normalize) == "a​b"  # entities resolve last
    assert one(spark, None, T.normalize) is None


def test_ghosts(spark):
    assert one(spark, "<|im_start|>hi[/INST] <s>x", T.strip_ghosts) == " hi   x"
    assert one(spark, "<s>x", lambda c: T.strip_ghosts(c, T.GHOST_PROSE)) == "<s>x"


def test_quality_modes_differ_on_hindi(spark):
    text = "भारत एक विशाल देश है जहाँ अनेक भाषाएँ बोली जाती हैं और लोग साथ रहते हैं। " * 2
    assert one(spark, text, lambda c: T.quality_reason(c, T.SCRIPT_AWARE)) is None
    assert one(spark, text, lambda c: T.quality_reason(c, T.ENGLISH)) is not None
    assert one(spark, "a b", lambda c: T.quality_reason(c, T.LATIN)) == "too_short"
    assert one(spark, "", lambda c: T.quality_reason(c, T.LATIN)) == "too_short"


def test_masks_in_order(spark):
    df = spark.createDataFrame([("mail me at a@b.com or 9876543210 from 10.0.0.1, id 1234 5678 9012",)], "text string")
    text, counts = T.masked(F.col("text"))
    row = df.select(text.alias("t"), *[c.alias(k) for k, c in counts.items()]).first()
    assert row["t"] == "mail me at <EMAIL> or <PHONE> from <IP>, id <AADHAAR>"
    assert (row["EMAIL"], row["AADHAAR"], row["PHONE"], row["IP"]) == (1, 1, 1, 1)


def test_greedy_scan_matches_python(spark, sf):
    keys = dedup.band_keys(table(spark, sf, "documents"))
    by_doc = defaultdict(list)
    for r in keys.collect():
        by_doc[r["doc_id"]].append((r["band"], r["key"]))
    seen, want = set(), set()
    for doc in sorted(by_doc):
        if any(k in seen for k in by_doc[doc]):
            want.add(doc)
        else:
            seen.update(by_doc[doc])
    got = {r["doc_id"] for r in dedup.greedy_duplicates(keys).collect()}
    assert got == want


def test_fingerprints_of_short_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "Only three words"), (2, ""), (3, "one two three four five six seven eight nine")], "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in df.select("doc_id", firewall.fingerprints(F.col("text")).alias("f")).collect()}
    assert [len(got[i]) for i in (1, 2, 3)] == [1, 0, 2]


def test_quota_totals_are_the_known_ones():
    total = defaultdict(int)
    for q in mixture.Schedule().quotas():
        assert sum(q["quota"].values()) == 8
        for k, v in q["quota"].items():
            total[k] += v
    assert dict(total) == {"general_web": 210, "code": 148, "indic": 103, "stem_math": 72, "reasoning": 39, "long_context": 48, "agentic": 20}


def test_conversation_budget_cuts_in_a_turn(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 10), (1, 1, "gpt", "y" * 50), (1, 2, "user", "z")], "conv_id long, turn long, role string, text string")
    segs = adapters.conversation_rows(df, cap=40).first()["segments"]
    assert [s["role"] for s in segs] == ["context", "target"]
    assert sum(len(s["text"]) for s in segs) == 40


def test_effective_stream_against_python(spark, sf):
    rows = [r.asDict() for r in L.simulate(table(spark, sf, "events")).collect()]
    back = [(r["branch"], r["to_offset"], r["offset"]) for r in rows if r["type"] == "rollback"]
    best = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        if r["type"] != "consumption" or any(b == r["branch"] and lo <= r["offset"] < hi for b, lo, hi in back):
            continue
        k = (r["branch"], r["step"], r["rank"], r["microbatch"])
        if k not in best or r["attempt"] > best[k]["attempt"]:
            best[k] = r
    got = {r["offset"] for r in L.effective(L.simulate(table(spark, sf, "events"))).collect()}
    assert got == {r["offset"] for r in best.values()}


def test_bpe_round_trip_and_order():
    merges = [(97, 98, 256), (256, 99, 257)]
    assert vocabulary.encode_bytes(b"abcab", merges) == [257, 256]
    assert vocabulary.encode_bytes(b"", merges) == []


def test_bpe_training(spark):
    df = spark.createDataFrame([("a", "abab abab ab"), ("b", "cdcd xy")], "lang string, text string")
    merges = vocabulary.train(vocabulary.word_table(df), 3)
    assert (97, 98) in {m[:2] for m in merges}
    got = vocabulary.encoded(df, merges).select("text", "ids").collect()
    assert all(list(r["ids"]) == [i for w in r["text"].split() for i in vocabulary.encode_bytes(w.encode(), merges)] for r in got)


def test_codecs():
    c = codecs.PhaseCodec(2048)
    assert c.decode(c.spectrum("hello"), 5) == b"hello"
    assert abs(c.concat("ab", "cd") - c.spectrum("abcd")).max() < 1e-9
    long = "क" * 12
    crop = codecs.ByteCodec(8, sinusoid=False)
    assert (crop.encode_one(long) == crop.encode_one("क" * 12)).all()
    assert codecs.utf8_truncate("अआ".encode(), 4) == "अ".encode()


def test_whole_units_fill(spark):
    df = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40)], "seq long, unit long, n long")
    got = [(r["unit"], r["dst_a"], r["dst_b"]) for r in packing.fill_whole(df, 100).orderBy("segment_id").collect()]
    assert got == [(1, 0, 60), (3, 60, 100)]


def test_admission_reasons_in_order(spark):
    df = spark.createDataFrame([("s", 0, "gpl-3.0,mit", False, True, "clean", "registry_member", False, False)], "shard string, token_count long, licenses string, tokenizer_ok boolean, lineage_ok boolean, overlap_status string, contamination_status string, never_train boolean, duplicate boolean")
    assert shards.admission(df).first()["reasons"] == "tokenizer_hash_mismatch;unsafe_license:gpl-3.0;contaminated:registry_member;empty_shard"


def test_sources(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert sorted(r["a"] for r in paged.json_lines(spark, str(p), "a long", tolerant=True).collect()) == [1, 2]
    assert paged.whole_json(spark, str(tmp_path / "none.json"), "a long", [(7,)]).first()["a"] == 7
    made = []
    build = lambda: (made.append(1), spark.range(3))[1]
    for _ in range(2):
        assert paged.stage_cache(spark, str(tmp_path / "c"), "s", 1, build).count() == 3
    assert len(made) == 1
    df = spark.range(4)
    assert paged.digest(df, "id") == paged.digest(df.orderBy(F.col("id").desc()), "id")
    assert with_defaults(df, type="web").first()["type"] == "web"
    try:
        require_columns(df, "nope")
        raise AssertionError
    except ValueError as e:
        assert "nope" in str(e)


def test_streams_equal_their_batch_twins(spark, sf, tmp_path):
    batch = table(spark, sf, "events")
    folder = str(tmp_path / "in")
    batch.repartition(3).write.parquet(folder)
    stream = lambda: W.event_stream(spark, folder + "/*.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(W.run(W.tumbling(stream()), str(tmp_path / "t"))) == rows(W.tumbling(batch))
    assert rows(W.run(W.sliding(stream()), str(tmp_path / "s"))) == rows(W.sliding(batch))
    assert rows(W.run(W.sessions(stream()), str(tmp_path / "e"))) == rows(W.sessions(batch))
    assert rows(W.run(W.deduplicated(stream()), str(tmp_path / "d"), "append")) == rows(W.deduplicated(batch))


def test_stream_resumes_once(spark, sf, tmp_path):
    batch = table(spark, sf, "events")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch.where("event_id < 500").coalesce(1).write.parquet(folder)
    stream = lambda: W.event_stream(spark, folder + "/*.parquet")
    W.run(stream(), str(tmp_path / "w"), "append", W.idempotent_append(out))
    batch.where("event_id >= 500").coalesce(1).write.mode("append").parquet(folder)
    W.run(stream(), str(tmp_path / "w"), "append", W.idempotent_append(out))
    assert spark.read.parquet(out).count() == batch.count()


def test_match_form_is_letters_and_numbers(spark):
    assert one(spark, "A-b  c", T.match_form) == "a b c"


def test_composed_series():
    assert T.composed(pd.Series(["é", None])).tolist() == ["é", None]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert os.path.isdir("/root/testdata/sf0.001")
    assert __spark_entry__.entry(spark).count() > 0


def test_stateful_threshold_equals_its_batch_twin(spark, sf, tmp_path):
    from millrace.plans.streams import stream_threshold

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    table(spark, sf, "events").where("event_id < 300").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = W.run(W.running_threshold(W.event_stream(spark, str(tmp_path / "in") + "/*.parquet")), str(tmp_path / "w"), "append")
    rows = lambda df: {(r["event_type"], r["event_id"]): r["thr"] and round(r["thr"], 5) for r in df.collect()}
    want = {k: v for k, v in rows(stream_threshold(spark, sf)).items() if k[1] < 300}
    assert rows(got) == want
