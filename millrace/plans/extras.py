"""Queries of samplers, expectation records, validation reads and small batch builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import codecs as C
from millrace.operators import rules as R
from millrace.operators.runs import numbered
from millrace.plans import cleaning, codecs, ledger
from millrace.plans.base import both, query
from millrace.session import importable
from millrace.sources.tables import table


@query("clean_expectations", f"WITH {cleaning.QUALITY} SELECT doc_id, md5({cleaning.NORMAL}) AS normal_md5, CAST(len(regexp_extract_all(text, '{cleaning.GHOST}')) AS BIGINT) AS ghosts, round(CASE WHEN visible > 0 THEN latin::DOUBLE / visible ELSE 0 END, 6) AS latin, reason IS NULL AS keep, reason_en IS NULL AS keep_en FROM r")
def clean_expectations(spark, d):
    """What every stage makes of a text, in one row."""
    importable(spark)
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(T.normalize(t)).alias("normal_md5"), F.regexp_count(t, F.lit(T.GHOST)).cast("long").alias("ghosts"), F.round(T.script_ratio(t, r"\p{IsLatin}"), 6).alias("latin"),
        R.reason(t, "latin").isNull().alias("keep"), R.reason(t, "english").isNull().alias("keep_en"),
    )


@query("clean_bucket_samples", "WITH a AS (SELECT doc_id FROM documents WHERE contains(text, '#') ORDER BY doc_id LIMIT 10), b AS (SELECT doc_id FROM documents WHERE length(text) > 2000 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY doc_id LIMIT 10), c AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b) ORDER BY doc_id LIMIT 10) SELECT doc_id, 'symbols' AS bucket FROM a UNION ALL SELECT doc_id, 'long' FROM b UNION ALL SELECT doc_id, 'any' FROM c")
def clean_bucket_samples(spark, d):
    t = F.col("text")
    rules = [("symbols", t.contains("#")), ("long", F.length(t) > 2000), ("any", F.lit(True))]
    return R.bucket_samples(table(spark, d, "documents").select("doc_id", "text"), rules, 10, "doc_id")


@query("rules_identity")
def rules_identity(spark, d):
    return spark.createDataFrame([(R.identity(),)], "identity string")


@query("spike_decisions", f"WITH {ledger.SERIES}, j AS (SELECT *, loss - lag(loss) OVER (ORDER BY step) AS jump FROM s), m AS (SELECT arg_max(step, jump) AS at_step FROM j) SELECT event_id, event_type FROM events, m WHERE event_type = 'error' AND event_id // 100 BETWEEN at_step - 3 AND at_step")
def spike_decisions(spark, d):
    """Decisions within three steps of the largest jump: the jump is one row."""
    events = table(spark, d, "events")
    at = F.broadcast(ledger.loss_spike(spark, d).select(F.col("step").alias("at_step")))
    return events.where("event_type = 'error'").withColumn("s", F.floor(F.col("event_id") / 100)).join(at, F.expr("s BETWEEN at_step - 3 AND at_step")).select("event_id", "event_type")


@query("pair_rows", r"WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents) SELECT doc_id // 2 AS pair, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN n ELSE 0 END) AS BIGINT) AS boundary, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) - count(*) AS BIGINT) AS loss_positions FROM n GROUP BY 1")
def pair_rows(spark, d):
    """Two documents a row; no position predicts over the boundary or the end."""
    n = table(spark, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("n"))
    return n.groupBy(F.floor(F.col("doc_id") / 2).alias("pair")).agg(
        F.sum(F.when(F.col("doc_id") % 2 == 0, F.col("n")).otherwise(0)).alias("boundary"), F.sum("n").alias("total"), (F.sum("n") - F.count("*")).alias("loss_positions")
    )


both("micro_batches", "events", "SELECT b AS micro, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT CASE WHEN event_id % 10 < 1 THEN 0 WHEN event_id % 10 < 3 THEN 1 ELSE 2 END AS b, value FROM events) t GROUP BY b")


@query("zipf_sample", f"WITH {codecs.TOKENS}, c AS (SELECT token, CAST(sum(n) OVER (ORDER BY n DESC, token) AS BIGINT) AS upto, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM t), u AS (SELECT i, ('0x' || substr(md5('z' || i), 1, 7))::BIGINT AS u FROM range(0, 100) AS r(i)) SELECT CAST(i AS BIGINT) AS draw, token FROM u JOIN c ON u % total >= upto - n AND u % total < upto")
def zipf_sample(spark, d):
    """A hundred draws by frequency: inverse running sums, draws broadcast (a fixed number)."""
    t = codecs.tokens(spark, d)
    total = F.broadcast(t.agg(F.sum("n").alias("total")))  # one row
    c = numbered(t, [], [F.col("n").desc(), F.col("token")], "upto", add="n").crossJoin(total)
    draws = spark.range(100).select(F.col("id").alias("draw"), F.conv(F.substring(F.md5(F.concat(F.lit("z"), "id")), 1, 7), 16, 10).cast("long").alias("u"))
    return c.join(F.broadcast(draws), F.expr("u % total >= upto - n AND u % total < upto")).select("draw", "token")


@query("relatedness", f"SELECT round(min({codecs.COS}) FILTER (a.label = b.label), 6) AS least_related, round(max({codecs.COS}) FILTER (a.label <> b.label), 6) AS most_unrelated FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def relatedness(spark, d):
    """Whether relatives are closer than strangers: the extreme cosines of all pairs, block by block."""
    return C.extreme_cosines(codecs.unit_vectors(spark, d)).select(F.round("least_same", 6).alias("least_related"), F.round("most_other", 6).alias("most_unrelated"))


both("validation_read", "documents", "SELECT CASE WHEN doc_id % 20 = 0 THEN 'validation' ELSE 'train' END AS kind, count(*) AS docs, min(doc_id) AS first_id FROM documents GROUP BY CASE WHEN doc_id % 20 = 0 THEN 'validation' ELSE 'train' END")
