"""Queries of stores and sinks: shard tables, caches, JSON in and out, run control, dashboards, generators."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import adapters as A
from millrace.operators import codecs as C
from millrace.operators import mixture as M
from millrace.operators import packing as P
from millrace.operators import stores as O
from millrace.operators.runs import numbered
from millrace.plans import cleaning
from millrace.plans.base import query
from millrace.plans.packing import NW, n_words
from millrace.session import importable
from millrace.sources import paged
from millrace.sources.tables import cut, shared_folder, table


def folder(spark) -> str:
    return f"{shared_folder(spark)}/millrace/{uuid.uuid4().hex}"


def docs(spark, d):
    return table(spark, d, "documents")


@query("shard_store", f"SELECT lang AS lane, doc_id // 64 AS shard, count(*) AS samples, CAST(sum({NW}) AS BIGINT) AS n_tokens FROM documents GROUP BY ALL")
def shard_store(spark, d):
    """Payloads written by lane and read back; a read of counts takes two columns."""
    path = f"{folder(spark)}/shards"
    rows = docs(spark, d).select(F.col("lang").alias("lane"), F.floor(F.col("doc_id") / 64).alias("shard"), "doc_id", F.array_compact(T.words(F.col("text"))).alias("tokens"), n_words().alias("n"))
    O.write_shards(rows, path)
    return O.read_shards(spark, path).groupBy("lane", "shard").agg(F.count("*").alias("samples"), F.sum("n").alias("n_tokens"))


@query("shard_cache", "SELECT count(DISTINCT user_id) AS shard_reads, count(*) - count(DISTINCT user_id) AS cache_hits, round((count(*) - count(DISTINCT user_id))::DOUBLE / count(*), 4) AS cache_hit_rate FROM events")
def shard_cache(spark, d):
    """Reads of a run (an event reads its user's shard), as a cache that keeps every shard sees them."""
    return O.cache_accounting(table(spark, d, "events").select(F.col("user_id").alias("shard"), "event_id"), "event_id")


@query("segments_clean", rf"WITH c AS (SELECT conv_id AS doc, turn, CASE WHEN role = 'assistant' THEN 'target' ELSE 'context' END AS role, {cleaning.NORMAL} AS x FROM conversations) SELECT doc, turn, role, md5(x) AS text_md5 FROM c WHERE length(x) > 0 AND NOT regexp_matches(x, '[0-9@<\[]')")
def segments_clean(spark, d):
    """Segments cleaned, roles kept; those with digits or @, where masks may bite, are held against Python in tests."""
    importable(spark)
    role = F.when(F.col("role") == "assistant", "target").otherwise("context")
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), "turn", role.alias("role"), "text")
    return O.clean_segments(s, F.lit(False)).where(~F.col("text").rlike("[0-9@<\\[]")).select("doc", "turn", "role", F.md5("text").alias("text_md5"))


LEDGER = "m AS (SELECT event_id // 50 AS step, md5(string_agg(event_id || ':' || event_type, ',' ORDER BY event_id)) AS hash FROM events GROUP BY 1)"


@query("run_control", f"WITH {LEDGER}, b AS (SELECT 'resume' AS branch, step, hash FROM m UNION ALL SELECT 'replay', step, hash FROM m WHERE step >= 60 UNION ALL SELECT 'fork', step, CASE WHEN step < 60 THEN hash ELSE md5('fork' || hash) END FROM m) SELECT branch, count(b.step) AS steps, count(*) FILTER (b.hash = m.hash) AS same, min(CASE WHEN b.hash IS DISTINCT FROM m.hash THEN m.step END) AS first_difference FROM (SELECT DISTINCT branch FROM b) n CROSS JOIN m LEFT JOIN b USING (branch, step) GROUP BY branch")
def run_control(spark, d):
    """A run that falls at step 75 and goes on from the checkpoint at 60; a replay from there; a fork there."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: F.concat_ws(":", e["event_id"].cast("string"), e["event_type"])), ",")
    main = cut(table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 50).alias("step")).agg(F.md5(listed).alias("hash")), "ledger")
    fork = main.where("step < 60").unionByName(main.where("step >= 60").withColumn("hash", F.md5(F.concat(F.lit("fork"), "hash"))))
    out = O.against(main, O.resumed(main, 60, 75, main), "resume")
    return out.unionByName(O.against(main, main.where("step >= 60"), "replay")).unionByName(O.against(main, fork, "fork"))


_LANES = ", ".join(f"({k}, '{lane}', '{P.POLICIES[lane]}', {M.HEADLINE[lane]}, {M.FLOORS.get(lane, 'NULL')})" for k, lane in enumerate(M.LANES))


@query("lane_dashboard_full", f"""WITH l AS (SELECT * FROM (VALUES {_LANES}) AS t(k, lane, policy, headline, floor_)),
actual AS (SELECT event_id % 7 AS k, count(*) AS sequences FROM events GROUP BY 1), pool AS (SELECT doc_id % 7 AS k, count(*) AS units, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY 1),
reserved AS (SELECT doc_id % 7 AS k, count(*) AS reserved_units FROM documents WHERE doc_id % 33 = 0 GROUP BY 1), judged AS (SELECT doc_id % 7 AS k, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality = 0) AS rejected FROM labels GROUP BY 1),
loss AS (SELECT event_id % 7 AS k, round(avg(value), 6) AS mean_loss FROM events GROUP BY 1), served AS (SELECT conv_id % 7 AS k, count(*) AS turns FROM conversations GROUP BY 1)
SELECT lane, policy, CAST(headline AS DOUBLE) AS headline, CAST(floor_ AS DOUBLE) AS floor_, coalesce(sequences, 0) AS sequences, coalesce(units, 0) AS units, coalesce(tokens, 0) AS tokens, coalesce(reserved_units, 0) AS reserved_units, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected, mean_loss, coalesce(turns, 0) AS turns
FROM l LEFT JOIN actual USING (k) LEFT JOIN pool USING (k) LEFT JOIN reserved USING (k) LEFT JOIN judged USING (k) LEFT JOIN loss USING (k) LEFT JOIN served USING (k)""")
def lane_dashboard_full(spark, d):
    """Every lane with what six tables say of it; each is aggregated to a row a lane before it is joined."""
    lanes = [(k, lane, P.POLICIES[lane], float(M.HEADLINE[lane]), M.FLOORS.get(lane)) for k, lane in enumerate(M.LANES)]
    out = spark.createDataFrame(lanes, "k long, lane string, policy string, headline double, floor_ double")
    of = lambda name, key: table(spark, d, name).withColumn("k", F.col(key) % 7)
    parts = [
        of("events", "event_id").groupBy("k").agg(F.count("*").alias("sequences")),
        of("documents", "doc_id").groupBy("k").agg(F.count("*").alias("units"), F.sum("n_chars").alias("tokens")),
        of("documents", "doc_id").where("doc_id % 33 = 0").groupBy("k").agg(F.count("*").alias("reserved_units")),
        of("labels", "doc_id").groupBy("k").agg(F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("quality") == 0).alias("rejected")),
        of("events", "event_id").groupBy("k").agg(F.round(F.avg("value"), 6).alias("mean_loss")),
        of("conversations", "conv_id").groupBy("k").agg(F.count("*").alias("turns")),
    ]
    for p in parts:
        out = out.join(p, "k", "left")
    return out.drop("k").na.fill(0, ["sequences", "units", "tokens", "reserved_units", "accepted", "rejected", "turns"])


@query("budget_fallback", "SELECT source, doc_id FROM (SELECT source, doc_id, coalesce(sum(n_chars) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 300000")
def budget_fallback(spark, d):
    """Sources in order until a budget of characters is met: where one falls short, the next goes on from there."""
    run = numbered(docs(spark, d).select("source", "doc_id", "n_chars"), [], ["source", "doc_id"], "upto", add="n_chars")
    return run.where(F.col("upto") - F.col("n_chars") < 300_000).select("source", "doc_id")


_LINE = "CASE WHEN doc_id % 10 = 0 THEN '' WHEN {bad} THEN '{{\"doc_id\": ' ELSE '{{\"lang\":\"' || lang || '\",\"doc_id\":' || doc_id || '}}' END"


def lines(spark, d, corrupt: bool) -> str:
    """JSON lines as a service may give them: some blank, some corrupt."""
    path = f"{folder(spark)}/lines"
    good = F.to_json(F.struct("lang", "doc_id"))
    bad = F.when((F.col("doc_id") % 7 == 3) & F.lit(corrupt), '{"doc_id": ')
    docs(spark, d).select(F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.coalesce(bad, good)).alias("value")).write.text(path)
    return path


@query("json_lines", "SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 0")
def json_lines(spark, d):
    return paged.json_lines(spark, lines(spark, d, False), "doc_id long, lang string")


@query("json_lines_tolerant", "SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 3")
def json_lines_tolerant(spark, d):
    return paged.json_lines(spark, lines(spark, d, True), "doc_id long, lang string", tolerant=True)


@query("json_sinks", "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def json_sinks(spark, d):
    """A manifest written as key-sorted JSON lines, and read."""
    path = f"{folder(spark)}/manifest"
    stats = docs(spark, d).groupBy("lang").agg(F.sum("n_chars").alias("n_chars"), F.count("*").alias("docs"))
    paged.write_json_lines(stats, path)
    return paged.json_lines(spark, path, "docs long, lang string, n_chars long")


@query("json_sink_lines", """SELECT md5('{"docs":' || count(*) || ',"lang":"' || lang || '","n_chars":' || sum(n_chars) || '}') AS line_md5 FROM documents GROUP BY lang""")
def json_sink_lines(spark, d):
    """The sink's lines as they stand: keys in order, no blanks."""
    path = f"{folder(spark)}/stats"
    paged.write_json_lines(docs(spark, d).groupBy("lang").agg(F.sum("n_chars").alias("n_chars"), F.count("*").alias("docs")), path)
    return spark.read.text(path).select(F.md5("value").alias("line_md5"))


@query("js_blob", """SELECT 'const DATA = [' || string_agg('{"lang":"' || lang || '","docs":' || n || '}', ',' ORDER BY lang) || '];' AS script FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)""")
def js_blob(spark, d):
    """A small result as a script's constant."""
    rows = docs(spark, d).where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("docs")).select("lang", F.to_json(F.struct("lang", "docs")).alias("j"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("lang", "j"))), lambda r: r["j"])
    return rows.agg(F.concat(F.lit("const DATA = ["), F.array_join(listed, ","), F.lit("];")).alias("script"))


@query("whole_json", "SELECT 'kept' AS name, count(*) AS n FROM documents UNION ALL SELECT 'absent', 0")
def whole_json(spark, d):
    """One JSON document, and a default where there is none."""
    path = f"{folder(spark)}/one"
    docs(spark, d).agg(F.count("*").alias("n")).select(F.lit("kept").alias("name"), "n").coalesce(1).write.json(path)
    there = paged.whole_json(spark, path, "name string, n long")
    return there.unionByName(paged.whole_json(spark, f"{path}-absent", "name string, n long", default=[("absent", 0)]))


@query("stage_cache", "SELECT 1 AS version, count(*) AS docs FROM documents UNION ALL SELECT 1, count(*) FROM documents UNION ALL SELECT 2, count(*) FROM documents WHERE lang IS NOT NULL")
def stage_cache(spark, d):
    """A stage's table is made once for a version: the second call reads the first's, another version is made anew."""
    where = folder(spark)
    first = paged.stage_cache(spark, where, "counts", 1, lambda: docs(spark, d).agg(F.count("*").alias("docs")))
    again = paged.stage_cache(spark, where, "counts", 1, lambda: docs(spark, d).limit(0).agg(F.count("*").alias("docs")))
    newer = paged.stage_cache(spark, where, "counts", 2, lambda: docs(spark, d).where("lang IS NOT NULL").agg(F.count("*").alias("docs")))
    return first.select(F.lit(1).alias("version"), "docs").union(again.select(F.lit(1), "docs")).union(newer.select(F.lit(2), "docs"))


@query("adapter_dispatch", "SELECT 'text' AS adapter, count(*) AS docs FROM documents UNION ALL SELECT 'code', count(*) FROM documents UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM conversations")
def adapter_dispatch(spark, d):
    made = [("text", docs(spark, d)), ("code", docs(spark, d).withColumn("row_license", F.lit(None).cast("string"))), ("conversations", table(spark, d, "conversations"))]
    out = None
    for name, df in made:
        one = A.adapt(name, df).agg(F.count("*").alias("docs")).select(F.lit(name).alias("adapter"), "docs")
        out = one if out is None else out.unionByName(one)
    return out


@query("utf8_cut", "WITH b AS (SELECT doc_id, encode(text) AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(decode(unhex(CASE WHEN regexp_matches(hex(b[102:102]), '^[89AB]') THEN regexp_replace(hex(b[1:101]), '[C-F][0-9A-F](?:[89AB][0-9A-F])*$', '') ELSE hex(b[1:101]) END))) AS head_md5 FROM b")
def utf8_cut(spark, d):
    """At most 101 bytes of each text, without a cut character."""
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(O.utf8_cut(F.col("text"), 101)).alias("head_md5"))


@query("phase_decode", "SELECT item_id, true AS same FROM benchmark")
def phase_decode(spark, d):
    """Texts of eight bytes come back from the sum of their bound bytes."""
    importable(spark)
    codec = C.PhaseCodec(1024)

    @F.pandas_udf("boolean")
    def back(t: pd.Series) -> pd.Series:
        return t.map(lambda x: codec.decode(codec.spectrum(x), 8) == x.encode())

    short = F.substring(F.concat(F.lpad(F.col("item_id").cast("string"), 6, "0"), F.lit("ab")), 1, 8)
    return table(spark, d, "benchmark").select("item_id", back(short).alias("same"))


@query("codec_policy", """SELECT '{"codec": "phase", "dims": 64, "seed": 7}' AS policy""")
def codec_policy(spark, d):
    return spark.createDataFrame([(C.PhaseCodec(64).policy_id(),)], "policy string")


@query("synthetic_moons", "SELECT CAST(i AS BIGINT) AS id, CAST(i % 2 AS INTEGER) AS label, round(CASE WHEN i % 2 = 0 THEN cos(pi() * i / 200) ELSE 1 - cos(pi() * i / 200) END, 6) AS x, round(CASE WHEN i % 2 = 0 THEN sin(pi() * i / 200) ELSE 0.5 - sin(pi() * i / 200) END, 6) AS y FROM range(0, 200) AS r(i)")
def synthetic_moons(spark, d):
    """Two half circles that reach into each other."""
    a, upper = F.pi() * F.col("id") / 200, F.col("id") % 2 == 0
    return spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("label"), F.round(F.when(upper, F.cos(a)).otherwise(1 - F.cos(a)), 6).alias("x"), F.round(F.when(upper, F.sin(a)).otherwise(0.5 - F.sin(a)), 6).alias("y"))


@query("synthetic_gaussians", "WITH u AS (SELECT i, (('0x' || substr(md5('u' || i), 1, 7))::BIGINT + 1) / 268435457.0 AS u, ('0x' || substr(md5('v' || i), 1, 7))::BIGINT / 268435456.0 AS v FROM range(0, 200) AS r(i)) SELECT CAST(i AS BIGINT) AS id, CAST(i % 3 AS INTEGER) AS label, round(4 * (i % 3) + sqrt(-2 * ln(u)) * cos(2 * pi() * v), 5) AS x, round(sqrt(-2 * ln(u)) * sin(2 * pi() * v), 5) AS y FROM u")
def synthetic_gaussians(spark, d):
    """Three clouds: two hashed uniforms a point, and their polar form."""
    hashed = lambda p: F.conv(F.substring(F.md5(F.concat(F.lit(p), "id")), 1, 7), 16, 10).cast("long")
    u, v = (hashed("u") + 1) / 268435457.0, hashed("v") / 268435456.0
    r, a = F.sqrt(-2 * F.log(u)), 2 * F.pi() * v
    return spark.range(200).select("id", (F.col("id") % 3).cast("int").alias("label"), F.round(4 * (F.col("id") % 3) + r * F.cos(a), 5).alias("x"), F.round(r * F.sin(a), 5).alias("y"))


_WHO, _DOES, _WHAT = ["the cat", "a child", "the old clock", "one bird"], ["sees", "follows", "forgets"], ["the river", "a lamp", "its own song", "the last door", "snow"]


@query("synthetic_sentences", "SELECT CAST(i AS BIGINT) AS id, [" + ", ".join(repr(x) for x in _WHO) + "][i % 4 + 1] || ' ' || [" + ", ".join(repr(x) for x in _DOES) + "][i // 4 % 3 + 1] || ' ' || [" + ", ".join(repr(x) for x in _WHAT) + "][i // 12 % 5 + 1] || '.' AS text FROM range(0, 60) AS r(i)")
def synthetic_sentences(spark, d):
    """Every sentence of a small grammar."""
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))
    i = F.col("id")
    return spark.range(60).select("id", F.concat(F.concat_ws(" ", pick(_WHO, i), pick(_DOES, F.floor(i / 4)), pick(_WHAT, F.floor(i / 12))), F.lit(".")).alias("text"))
