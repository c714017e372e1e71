"""Queries of row adapters and of documents in segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import adapters as O
from millrace.plans.base import query
from millrace.sources.tables import table

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TURNS = """t AS (SELECT conv_id, turn, CASE WHEN lower(role) IN ('gpt', 'assistant') THEN 'target' ELSE 'context' END AS role, '<' || lower(role) || '> ' || text AS x FROM conversations),
u AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
c AS (SELECT conv_id, turn, role, substr(x, 1, CAST(8000 - before AS BIGINT)) AS x FROM u WHERE before < 8000)"""


def docs(spark, d):
    return table(spark, d, "documents")


def talks(spark, d):
    return O.adapt("conversations", table(spark, d, "conversations"))


@query("adapter_text", f"SELECT doc_id, 'target' AS role, md5(substr({STRIP.format('text')}, 1, 6000)) AS text_md5 FROM documents")
def adapter_text(spark, d):
    s = F.col("segments")[0]
    return O.adapt("text", docs(spark, d)).select("doc_id", s["role"].alias("role"), F.md5(s["text"]).alias("text_md5"))


@query("adapter_code", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'mit' ELSE 'per-row' END AS license, lang AS language, CAST(length(substr({STRIP.format('text')}, 1, 6000)) AS BIGINT) AS chars FROM documents")
def adapter_code(spark, d):
    rows = docs(spark, d).withColumn("row_license", F.when(F.col("doc_id") % 2 == 0, "mit"))
    made = O.adapt("code", rows, default_license="per-row")
    return made.select("doc_id", "license", F.col("meta")["language"].alias("language"), F.length(F.col("segments")[0]["text"]).cast("long").alias("chars"))


@query("adapter_qa", f"SELECT q.conv_id, q.turn, md5('Question: ' || substr({STRIP.format('q.text')}, 1, 4000)) AS question_md5, md5('Answer: ' || substr({STRIP.format('a.text')}, 1, 4000)) AS answer_md5 FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def adapter_qa(spark, d):
    c = table(spark, d, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    made = O.adapt("qa", q.join(a, ["conv_id", "turn"]))
    return made.select("conv_id", "turn", F.md5(F.col("segments")[0]["text"]).alias("question_md5"), F.md5(F.col("segments")[1]["text"]).alias("answer_md5"))


@query("adapter_choices", rf"SELECT item_id, md5(substr({STRIP.format('text')} || chr(10) || array_to_string(list_transform(c, lambda x, i: chr(CAST(64 + i AS INTEGER)) || '. ' || x), chr(10)), 1, 4000)) AS body_md5 FROM (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:4] AS c FROM benchmark)")
def adapter_choices(spark, d):
    """The first four words of an item as its choices."""
    b = table(spark, d, "benchmark")
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    made = O.adapt("mmlu", b.select("item_id", F.col("text").alias("question"), F.slice(w, 1, 4).alias("choices")))
    return made.select("item_id", F.md5(F.col("segments")[0]["text"]).alias("body_md5"))


@query("seg_conversations", f"WITH {TURNS} SELECT conv_id, count(*) AS segments, count(*) FILTER (role = 'target') AS targets, md5(string_agg(role || ':' || x, chr(10) ORDER BY turn)) AS document_md5 FROM c GROUP BY conv_id")
def seg_conversations(spark, d):
    s = F.col("segments")
    text = F.array_join(F.transform(s, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return talks(spark, d).select(
        "conv_id", F.size(s).cast("long").alias("segments"), F.size(F.filter(s, lambda x: x["role"] == "target")).cast("long").alias("targets"), F.md5(text).alias("document_md5")
    )


@query("adapter_budget_cut", f"WITH {TURNS} SELECT conv_id, CAST(sum(length(x)) AS BIGINT) AS chars, max(turn) AS last_turn FROM c GROUP BY conv_id")
def adapter_budget_cut(spark, d):
    total = F.aggregate("segments", F.lit(0), lambda acc, s: acc + F.length(s["text"])).cast("long")
    made = talks(spark, d).select("conv_id", total.alias("chars"), F.size("segments").alias("n"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    return made.join(turns, "conv_id").select("conv_id", "chars", F.element_at("t", F.col("n")).alias("last_turn"))


@query("seg_pairs", f"WITH {TURNS}, p AS (SELECT conv_id, string_agg(x, chr(10) ORDER BY turn) FILTER (role = 'context') AS context, string_agg(x, chr(10) ORDER BY turn) FILTER (role = 'target') AS target FROM c GROUP BY conv_id) SELECT conv_id, md5(context) AS context_md5, md5(target) AS target_md5 FROM p WHERE trim(context) <> '' AND trim(target) <> ''")
def seg_pairs(spark, d):
    return O.pairs(talks(spark, d)).select("conv_id", F.md5("context").alias("context_md5"), F.md5("target").alias("target_md5"))


@query("split_long_docs", f"WITH s AS (SELECT doc_id, substr({STRIP.format('text')}, 1, 3000) AS t FROM documents), p AS (SELECT doc_id, i AS part, substr(t, CAST(i * 1000 + 1 AS BIGINT), 1000) AS x FROM s, range(0, 3) AS r(i) WHERE i * 1000 < greatest(length(t), 1)) SELECT doc_id, CAST(part AS INTEGER) AS part, md5(x) AS part_md5 FROM p WHERE length({STRIP.format('x')}) >= 200")
def split_long_docs(spark, d):
    """Parts of a third of a cap of 3,000 characters."""
    return O.adapt("book", docs(spark, d), cap=3000).select("doc_id", "part", F.md5("text").alias("part_md5"))


@query("adapter_usable", f"SELECT doc_id, CAST(length(x) AS BIGINT) AS chars, sha256(x) AS text_sha256 FROM (SELECT doc_id, substr({STRIP.format('text')}, 1, 6000) AS x FROM documents) WHERE length(x) >= 64")
def adapter_usable(spark, d):
    made = O.usable(O.adapt("text", docs(spark, d)))
    return made.select("doc_id", "chars", F.sha2(O.flatten(F.col("segments")), 256).alias("text_sha256"))


@query("source_records", f"SELECT source AS source_id, count(*) AS docs_kept, CAST(min(doc_id) AS BIGINT) AS first_id, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS text_sha256 FROM documents WHERE length({STRIP.format('text')}) >= 64 GROUP BY source")
def source_records(spark, d):
    """Provenance of each source; its digest is one of the documents' digests, so texts stay where they are."""
    kept = docs(spark, d).where(F.length(O.stripped(F.col("text"))) >= O.MIN_DOCUMENT).select("source", "doc_id", F.sha2("text", 256).alias("h"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "h"))), lambda s: s["h"]), "")
    return kept.groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("docs_kept"), F.min("doc_id").alias("first_id"), F.sha2(listed, 256).alias("text_sha256"))
