"""Stores and segment cleaning against plain values."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import runs, stores


def test_segments_keep_roles_and_lose_empty_ones(spark):
    rows = [(1, 0, "context", "  write to a.b@example.org  "), (1, 1, "target", "\u200b \n"), (1, 2, "target", "call 9876543210 or 10.0.0.1"), (2, 0, "context", None), (2, 1, "target", "plain")]
    df = spark.createDataFrame(rows, "doc long, turn int, role string, text string")
    got = {(r["doc"], r["turn"]): (r["role"], r["text"], r["pii_removed"]) for r in stores.clean_segments(df, F.lit(True)).collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 1)}
    assert got[1, 0] == ("context", "write to <EMAIL>", 1) and got[1, 2][0] == "target" and got[1, 2][2] == 2 and got[2, 1] == ("target", "plain", 0)


def test_reads_of_one_lane_open_no_other(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 4).cast("string").alias("lane"), (F.col("id") % 10).alias("shard"), F.col("id").alias("v"))
    stores.write_shards(df, f"{tmp_path}/s")
    one = stores.read_shards(spark, f"{tmp_path}/s", ["2"])
    assert one.count() == 25 and "PartitionFilters: [" in one._jdf.queryExecution().toString()
    hit = stores.cache_accounting(df, "v").first()
    assert (hit["shard_reads"], hit["cache_hits"], hit["cache_hit_rate"]) == (10, 90, 0.9)
    assert stores.cache_accounting(df.limit(0), "v").first()["cache_hit_rate"] == 0.0


def test_branches_against_the_main_run(spark):
    main = spark.createDataFrame([(i, f"h{i}") for i in range(10)], "step long, hash string")
    again = main.withColumn("hash", F.when(F.col("step") == 7, "x").otherwise(F.col("hash")))
    row = stores.against(main, stores.resumed(main, 5, 8, again), "resume").first()
    assert (row["steps"], row["same"], row["first_difference"]) == (10, 9, 7)


def test_cut_texts_are_whole_characters(spark):
    texts = ["", "abc", "é" * 9, "漢字かな", "😀😀😀", "aé漢😀z"]
    for n in range(1, 14):
        got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(stores.utf8_cut(F.col("t"), n)).collect()]
        assert got == [t.encode()[:n].decode(errors="ignore") for t in texts]


def test_running_sum_of_an_empty_table(spark):
    assert runs.numbered(spark.range(0), [], ["id"]).count() == 0
