"""Queries of exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import lines, words
from millrace.operators import dedup as O
from millrace.plans.base import query
from millrace.sources.tables import cut, table

P = O.Lsh()
SIG = "[" + ", ".join(f"list_min(list_transform(h, lambda x: (x * {a}::BIGINT + {b}) % {O.PRIME}))" for a, b in P.permutations()) + "]"
H = "('0x' || substr(md5({}), 1, 7))::BIGINT"
SHINGLES = rf"""sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: {H.format("array_to_string(w[i:i+4], ' ')")}) ELSE [{H.format('text')}] END) AS h
 FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents))"""
BANDS = f"""{SHINGLES}, sg AS (SELECT doc_id, {SIG} AS s FROM sh),
bk AS (SELECT doc_id, b, array_to_string(s[b*4+1:b*4+4], '-') AS k FROM sg, range(0, 16) AS t(b)),
pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bk x JOIN bk y ON x.b = y.b AND x.k = y.k AND x.doc_id < y.doc_id)"""


def docs(spark, d):
    return table(spark, d, "documents")


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha1(text)")
def dedup_exact(spark, d):
    return docs(spark, d).groupBy(F.sha1("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("dedup_first_copies", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first_copies(spark, d):
    return O.first_copies(docs(spark, d).select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("dedup_duplicate_of", "SELECT doc_id, nullif(first_value(doc_id) OVER (PARTITION BY sha1(text) ORDER BY doc_id), doc_id) AS duplicate_of FROM documents")
def dedup_duplicate_of(spark, d):
    return O.duplicate_of(docs(spark, d).select("doc_id", F.sha1("text").alias("h")), "h", "doc_id").select("doc_id", "duplicate_of")


@query("dedup_shingles", f"WITH {SHINGLES} SELECT doc_id, CAST(len(h) AS BIGINT) AS shingles, list_min(h) AS least, list_max(h) AS most FROM sh")
def dedup_shingles(spark, d):
    return docs(spark, d).select("doc_id", O.shingle_hashes(F.col("text"), 5).alias("h")).select(
        "doc_id", F.size("h").cast("long").alias("shingles"), F.array_min("h").alias("least"), F.array_max("h").alias("most")
    )


@query("dedup_signature", f"WITH {SHINGLES} SELECT doc_id, md5(array_to_string({SIG}, ',')) AS signature_md5 FROM sh")
def dedup_signature(spark, d):
    return O.signatures(docs(spark, d), P).select("doc_id", F.md5(F.array_join("s", ",")).alias("signature_md5"))


def representatives(spark, d):
    """Bands of the first document of each text."""
    return O.band_keys(docs(spark, d)).join(O.text_classes(docs(spark, d)).select("doc_id"), "doc_id", "left_semi")


@query("dedup_near_pairs", f"WITH {BANDS}, f AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS first_id FROM documents) SELECT a, b, 'near' AS kind FROM pairs JOIN f x ON x.doc_id = a AND x.first_id = a JOIN f y ON y.doc_id = b AND y.first_id = b UNION ALL SELECT first_id, doc_id, 'copy' FROM f WHERE first_id <> doc_id")
def dedup_near_pairs(spark, d):
    """Pairs of different texts that share a band, each text by its first document; and the copies of each."""
    near = O.candidate_pairs(representatives(spark, d)).select("a", "b", F.lit("near").alias("kind"))
    digests = docs(spark, d).select("doc_id", F.sha1("text").alias("h"))
    copies = O.duplicate_of(digests, "h", "doc_id").where("duplicate_of IS NOT NULL")
    return near.union(copies.select(F.col("duplicate_of").alias("a"), F.col("doc_id").alias("b"), F.lit("copy").alias("kind")))


@query("dedup_near_greedy")
def dedup_near_greedy(spark, d):
    """What a scan by doc_id drops (order-dependent: held against plain Python in tests)."""
    return O.greedy_duplicates(O.band_keys(docs(spark, d)))


@query("dedup_near_keep", f"WITH RECURSIVE {BANDS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other) SELECT doc_id FROM r GROUP BY doc_id HAVING min(other) < doc_id")
def dedup_near_keep(spark, d):
    """What a keep of one document (the first) a component of near pairs drops."""
    return O.component_duplicates(O.band_keys(docs(spark, d)))


@query("dedup_local_vs_global", f"WITH {BANDS} SELECT count(*) AS global_pairs, count(*) FILTER (a % 4 = b % 4) AS local_pairs, count(*) FILTER (a % 4 <> b % 4) AS cross_shard FROM pairs")
def dedup_local_vs_global(spark, d):
    """Pairs that four shards by themselves would miss, counted from pairs of texts and how many copies each shard has."""
    shards = [F.count_if(F.col("doc_id") % 4 == k).alias(f"s{k}") for k in range(4)]
    texts = cut(O.text_classes(docs(spark, d), *shards), "texts")
    near = O.candidate_pairs(O.band_keys(docs(spark, d)).join(texts.select("doc_id"), "doc_id", "left_semi"))
    side = lambda name: texts.select(F.col("doc_id").alias(name), F.col("copies").alias(f"n_{name}"), *[F.col(f"s{k}").alias(f"s{k}_{name}") for k in range(4)])
    apart = near.join(side("a"), "a").join(side("b"), "b").agg(
        F.sum(F.col("n_a") * F.col("n_b")).alias("n"), F.sum(sum(F.col(f"s{k}_a") * F.col(f"s{k}_b") for k in range(4))).alias("local")
    )
    twice = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    alike = texts.agg(F.sum(twice("copies")).alias("n"), F.sum(sum(twice(f"s{k}") for k in range(4))).alias("local"))
    total = apart.union(alike).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("global_pairs"), F.coalesce(F.sum("local"), F.lit(0)).alias("local_pairs"))
    return total.withColumn("cross_shard", F.col("global_pairs") - F.col("local_pairs"))


@query("dedup_union_removed", f"WITH {BANDS}, ex AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1), gone AS (SELECT doc_id FROM ex UNION SELECT b FROM pairs) SELECT count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN gone USING (doc_id)")
def dedup_union_removed(spark, d):
    """Exact copies and every later member of a near pair, together."""
    all_docs = docs(spark, d)
    copies = O.duplicate_of(all_docs.select("doc_id", F.sha1("text").alias("h")), "h", "doc_id").where("duplicate_of IS NOT NULL").select("doc_id")
    near = O.later_members(O.band_keys(all_docs))
    return all_docs.join(copies.union(near).distinct(), "doc_id", "left_semi").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("dedup_dup_lines", r"SELECT doc_id, round(CASE WHEN len(l) > 0 THEN 1 - len(list_distinct(l))::DOUBLE / len(l) ELSE 0 END, 6) AS dup_lines FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents)")
def dedup_dup_lines(spark, d):
    ln = lines(F.col("text"))
    share = F.when(F.size(ln) > 0, 1 - F.size(F.array_distinct(ln)) / F.size(ln)).otherwise(F.lit(0.0))
    return docs(spark, d).select("doc_id", F.round(share, 6).alias("dup_lines"))


@query("dedup_jaccard", f"WITH {BANDS}, f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha1(text)) SELECT a, b, round(len(list_intersect(x.h, y.h))::DOUBLE / (len(x.h) + len(y.h) - len(list_intersect(x.h, y.h))), 6) AS jaccard FROM pairs JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b WHERE a IN (SELECT doc_id FROM f) AND b IN (SELECT doc_id FROM f)")
def dedup_jaccard(spark, d):
    """Candidates of different texts, each by its first document, with the exact similarity of their shingle sets."""
    all_docs = docs(spark, d)
    sets = all_docs.select("doc_id", O.shingle_hashes(F.col("text"), 5).alias("h"))
    met = O.candidate_pairs(representatives(spark, d)).join(sets.select(F.col("doc_id").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("h").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return met.select("a", "b", F.round(common / (F.size("x") + F.size("y") - common), 6).alias("jaccard"))


@query("word_counts_by_lang", r"SELECT lang, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS BIGINT) AS words, count(DISTINCT text) AS texts FROM documents GROUP BY lang")
def word_counts_by_lang(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.sum(F.size(words(F.col("text")))).cast("long").alias("words"), F.countDistinct("text").alias("texts"))
