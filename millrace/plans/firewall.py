"""Queries of the evaluation firewall and of decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import match_form
from millrace.operators import firewall as O
from millrace.plans.base import query
from millrace.sources.tables import table

FORM = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')"


def FP(tab: str, key: str) -> str:  # noqa: N802
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN f = '' THEN [] WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: substr(sha256(array_to_string(w[i:i+7], ' ')), 1, 16)) ELSE [substr(sha256(f), 1, 16)] END) AS fp
 FROM (SELECT {key}, f, string_split(f, ' ') AS w FROM (SELECT {key}, {FORM} AS f FROM {tab}))"""


INDEX = f"ix AS ({FP('benchmark', 'item_id')}), px AS (SELECT * FROM ix WHERE fp IN (SELECT fp FROM ix GROUP BY fp HAVING count(DISTINCT item_id) <= 3))"
HITS = f"{INDEX}, df AS ({FP('documents', 'doc_id')}), hit AS (SELECT doc_id, item_id AS reg_id, count(*) AS n FROM df JOIN px USING (fp) GROUP BY ALL)"
WINDOWS = "SELECT {k}, unnest(list_transform(range(0, greatest(1, length(text) - 120), 40), lambda i: sha1(substr(text, i + 1, 120)))) AS w FROM {t}"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang")


def registry(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


@query("fp_match_form", f"SELECT doc_id, md5({FORM}) AS form_md5 FROM documents")
def fp_match_form(spark, d):
    return docs(spark, d).select("doc_id", F.md5(match_form(F.col("text"))).alias("form_md5"))


@query("fp_index", f"WITH {INDEX} SELECT item_id AS reg_id, fp FROM ix")
def fp_index(spark, d):
    return O.index(registry(spark, d))


@query("fp_df_prune", f"WITH {INDEX} SELECT (SELECT count(*) FROM ix) AS entries, (SELECT count(*) FROM px) AS kept, (SELECT count(DISTINCT fp) FROM ix) - (SELECT count(DISTINCT fp) FROM px) AS boilerplate")
def fp_df_prune(spark, d):
    entries = O.index(registry(spark, d))
    df = entries.groupBy("fp").agg(F.countDistinct("reg_id").alias("df"))
    kept = F.col("df") <= O.MAX_DOCS
    return df.agg(F.sum("df").alias("entries"), F.coalesce(F.sum(F.when(kept, F.col("df"))), F.lit(0)).alias("kept"), F.count_if(~kept).alias("boilerplate"))


@query("decontam_hits", f"WITH {HITS} SELECT doc_id, reg_id, n FROM hit")
def decontam_hits(spark, d):
    return O.hits(docs(spark, d), registry(spark, d))


@query("decontam_clean", f"WITH {HITS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit WHERE n >= 5)")
def decontam_clean(spark, d):
    bad = O.hits(docs(spark, d), registry(spark, d)).where(F.col("n") >= O.MIN_HITS)
    return docs(spark, d).select("doc_id").join(bad, "doc_id", "left_anti")


@query("registry_verdict", f"WITH {HITS}, s AS (SELECT source, reg_id, CAST(sum(n) AS BIGINT) AS n FROM hit JOIN documents USING (doc_id) GROUP BY ALL) SELECT source, max(n) AS worst_hits, arg_max(reg_id, n * 100000 - reg_id) AS worst, 'overlap:item' || arg_max(reg_id, n * 100000 - reg_id) AS status FROM s WHERE n >= 5 GROUP BY source")
def registry_verdict(spark, d):
    """A shard (here: a source) is flagged by any registered document that it shares five fingerprints with."""
    found = O.hits(docs(spark, d), registry(spark, d)).join(docs(spark, d).select("doc_id", "source"), "doc_id")
    summed = found.groupBy("source", "reg_id").agg(F.sum("n").alias("n")).where(F.col("n") >= O.MIN_HITS)
    worst = F.max_by("reg_id", F.struct("n", -F.col("reg_id")))
    return summed.groupBy("source").agg(F.max("n").alias("worst_hits"), worst.alias("worst"), F.concat(F.lit("overlap:item"), worst.cast("string")).alias("status"))


@query("window_sha_scan", f"WITH b AS ({WINDOWS.format(k='item_id', t='benchmark')}), x AS ({WINDOWS.format(k='doc_id', t='documents')}) SELECT doc_id, count(DISTINCT w) AS windows FROM x WHERE w IN (SELECT w FROM b) GROUP BY doc_id")
def window_sha_scan(spark, d):
    marks = O.windows(table(spark, d, "benchmark"), "item_id").select("w").distinct()
    return O.windows(docs(spark, d), "doc_id").join(marks, "w", "left_semi").groupBy("doc_id").agg(F.countDistinct("w").alias("windows"))


@query("canary_scan", f"SELECT source, count(*) AS docs, count(*) FILTER (contains(t, '{O.CANARY}')) AS canaries FROM (SELECT source, CASE WHEN doc_id % 97 = 0 THEN text || '{O.CANARY}' ELSE text END AS t FROM documents) GROUP BY source")
def canary_scan(spark, d):
    t = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit(O.CANARY))).otherwise(F.col("text"))
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("docs"), F.count_if(t.contains(O.CANARY)).alias("canaries"))


@query("splice_attack", "SELECT d.doc_id, md5(substr(d.text, 1, length(d.text) // 2) || chr(10) || b.text || chr(10) || substr(d.text, length(d.text) // 2 + 1)) AS spliced_md5 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40")
def splice_attack(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("planted"))
    return docs(spark, d).withColumn("k", F.col("doc_id") % 40).join(b, "k").select("doc_id", F.md5(O.splice(F.col("text"), F.col("planted"))).alias("spliced_md5"))


@query("never_train_guard", f"WITH {HITS}, never AS (SELECT DISTINCT doc_id FROM hit WHERE n >= 5) SELECT d.source, count(*) AS served, count(never.doc_id) AS violations, bool_or(never.doc_id IS NOT NULL) AS blocked FROM documents d LEFT JOIN never USING (doc_id) GROUP BY d.source")
def never_train_guard(spark, d):
    never = O.hits(docs(spark, d), registry(spark, d)).where(F.col("n") >= O.MIN_HITS).select("doc_id").distinct().withColumn("never", F.lit(True))
    joined = docs(spark, d).select("doc_id", "source").join(never, "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("served"), F.count("never").alias("violations"), F.max(F.col("never").isNotNull()).alias("blocked"))


@query("access_log_tail", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 200")
def access_log_tail(spark, d):
    """The last 200 entries of a log: top-k, no global window."""
    return table(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(200).select("event_id", "user_id", "event_type")


@query("block_events", "SELECT event_type, count(*) AS events, count(*) FILTER (value > 50) AS blocked, max(event_id) AS last_id FROM events GROUP BY event_type")
def block_events(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("value") > 50).alias("blocked"), F.max("event_id").alias("last_id"))


@query("eval_shard_class", "SELECT source, bool_or(doc_id % 50 = 0) AS is_test FROM documents GROUP BY source")
def eval_shard_class(spark, d):
    """A shard counts as test if any of its documents does."""
    return docs(spark, d).groupBy("source").agg(F.bool_or(F.col("doc_id") % 50 == 0).alias("is_test"))


@query("benchmark_word_collision", r"WITH b AS (SELECT DISTINCT unnest(string_split(" + FORM + r", ' ')) AS w FROM benchmark), x AS (SELECT lang, unnest(string_split(" + FORM + r", ' ')) AS w FROM documents) SELECT lang, count(*) AS words, count(b.w) AS collided, round(100.0 * count(b.w) / count(*), 4) AS pct FROM x LEFT JOIN b USING (w) GROUP BY lang")
def benchmark_word_collision(spark, d):
    b = table(spark, d, "benchmark").select(F.explode(F.split(match_form(F.col("text")), " ")).alias("w")).distinct().withColumn("hit", F.lit(1))
    x = docs(spark, d).select("lang", F.explode(F.split(match_form(F.col("text")), " ")).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    joined = x.join(b, "w", "left")
    collided = F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0))
    return joined.groupBy("lang").agg(F.sum("n").alias("words"), collided.alias("collided"), F.round(100.0 * collided / F.sum("n"), 4).alias("pct"))
