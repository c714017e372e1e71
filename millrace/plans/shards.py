"""Queries of shards, manifests, admission and vocabulary remaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import shards as O
from millrace.plans.base import query
from millrace.sources.tables import table

W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
PLACED = f"""a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos_, CAST(len({W}) + 1 AS BIGINT) AS n_tokens,
   CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'MIT' WHEN 2 THEN 'gpl-3.0' ELSE 'cc-by-4.0' END AS license FROM documents),
p AS (SELECT *, source || '.' || lpad(CAST(pos_ // 20 AS VARCHAR), 4, '0') AS shard, pos_ % 20 AS sample_index FROM a),
o AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY shard ORDER BY sample_index) AS BIGINT) AS token_end FROM p),
m AS (SELECT shard, count(*) AS n_samples, CAST(sum(n_tokens) AS BIGINT) AS token_count, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages,
   array_to_string(list_sort(list_distinct(list(lower(coalesce(license, 'unknown'))))), ',') AS licenses, sha256(string_agg(sha256(text), '' ORDER BY sample_index)) AS content_hash FROM o GROUP BY shard)"""
TOK = f"t AS (SELECT unnest({W}) AS token FROM documents), n AS (SELECT token, count(*) AS n FROM t GROUP BY token)"


def licensed(spark, d):
    lic = F.expr("CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'MIT' WHEN 2 THEN 'gpl-3.0' ELSE 'cc-by-4.0' END")
    return table(spark, d, "documents").withColumn("license", lic)


def placed(spark, d):
    return O.offsets(O.assign(licensed(spark, d)))


def counts(spark, d):
    return table(spark, d, "documents").select(F.explode(O.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("shard_assign", f"WITH {PLACED} SELECT doc_id, shard, CAST(sample_index AS BIGINT) AS sample_index FROM p")
def shard_assign(spark, d):
    return O.assign(table(spark, d, "documents").select("doc_id", "source")).select("doc_id", "shard", F.col("sample_index").cast("long").alias("sample_index"))


@query("shard_offsets", f"WITH {PLACED} SELECT doc_id, shard, token_end - n_tokens AS token_start, token_end FROM o")
def shard_offsets(spark, d):
    return placed(spark, d).select("doc_id", "shard", "token_start", "token_end")


@query("shard_manifest", f"WITH {PLACED} SELECT * FROM m")
def shard_manifest(spark, d):
    return O.manifests(placed(spark, d))


def flagged(m):
    n = F.conv(F.substring("content_hash", 1, 2), 16, 10).cast("int")
    return m.withColumns({
        "tokenizer_ok": n % 11 != 0, "lineage_ok": n % 13 != 0, "overlap_status": F.when(n % 5 == 0, "overlap:item").otherwise("clean"),
        "contamination_status": F.when(n % 17 == 0, "registry_member").otherwise("pending"), "never_train": n % 19 == 0, "duplicate": n % 23 == 0,
    })


FLAGS = f"""{PLACED}, f AS (SELECT *, ('0x' || substr(content_hash, 1, 2))::INT AS n FROM m),
g AS (SELECT *, list_filter(string_split(licenses, ','), lambda x: NOT list_contains({O.LICENSES!r}, x)) AS bad FROM f),
v AS (SELECT *, array_to_string(list_filter([CASE WHEN n % 11 = 0 THEN 'tokenizer_hash_mismatch' END, CASE WHEN n % 13 = 0 THEN 'unknown_cleaning_lineage' END,
  CASE WHEN len(bad) > 0 THEN 'unsafe_license:' || array_to_string(bad, ',') END, CASE WHEN n % 5 = 0 THEN 'eval_overlap:overlap:item' END,
  CASE WHEN n % 17 = 0 THEN 'contaminated:registry_member' END, CASE WHEN n % 19 = 0 THEN 'never_train_flag' END, CASE WHEN n % 23 = 0 THEN 'duplicate' END,
  CASE WHEN token_count = 0 THEN 'empty_shard' END], lambda x: x IS NOT NULL), ';') AS reasons FROM g)"""


@query("admission", f"WITH {FLAGS} SELECT shard, CASE WHEN reasons = '' THEN 'admitted' ELSE 'rejected' END AS verdict, reasons FROM v")
def admission(spark, d):
    return O.admission(flagged(O.manifests(placed(spark, d)))).select("shard", "verdict", "reasons")


@query("admission_reasons", f"WITH {FLAGS}, r AS (SELECT unnest(string_split(reasons, ';')) AS reason FROM v WHERE reasons <> '') SELECT split_part(reason, ':', 1) AS reason, count(*) AS shards FROM r GROUP BY 1")
def admission_reasons(spark, d):
    r = O.admission(flagged(O.manifests(placed(spark, d)))).where("reasons <> ''").select(F.explode(F.split("reasons", ";")).alias("r"))
    return r.groupBy(F.split("r", ":")[0].alias("reason")).agg(F.count("*").alias("shards"))


@query("manifest_validate", f"WITH {PLACED}, c AS (SELECT shard, count(*) AS n, sum(n_tokens) AS t, max(token_end) AS e, min(sample_index) AS lo, max(sample_index) AS hi FROM o GROUP BY shard) SELECT shard, (n_samples = n AND token_count = t AND t = e AND lo = 0 AND hi = n - 1 AND length(content_hash) = 64) AS valid FROM m JOIN c USING (shard)")
def manifest_validate(spark, d):
    """Six checks of every manifest against its recomputed segments."""
    p = placed(spark, d)
    c = p.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max("token_end").alias("e"), F.min("sample_index").alias("lo"), F.max("sample_index").alias("hi"))
    return O.manifests(p).join(c, "shard").select(
        "shard", F.expr("n_samples = n AND token_count = t AND t = e AND lo = 0 AND hi = n - 1 AND length(content_hash) = 64").alias("valid")
    )


@query("shard_derive", f"WITH {PLACED} SELECT shard AS parent, shard || '.d' AS shard, count(*) AS n_samples, sha256(string_agg(sha256(text), '' ORDER BY sample_index)) AS content_hash FROM o WHERE sample_index % 2 = 0 GROUP BY shard")
def shard_derive(spark, d):
    """Every other sample as a new shard with a link to its parent; the parent stays."""
    half = placed(spark, d).where("sample_index % 2 = 0").withColumn("parent", F.col("shard")).withColumn("shard", F.concat("shard", F.lit(".d")))
    m = O.manifests(half)
    return m.join(half.select("shard", "parent").distinct(), "shard").select("parent", "shard", "n_samples", "content_hash")


@query("manifest_license_gate", f"WITH {PLACED} SELECT shard, CASE WHEN contains(licenses, 'unknown') OR contains(licenses, 'gpl') OR licenses = '' OR content_hash IS NULL OR token_count IS NULL THEN 'blocked' ELSE 'pass' END AS gate FROM m")
def manifest_license_gate(spark, d):
    bad = F.col("licenses").contains("unknown") | F.col("licenses").contains("gpl") | (F.col("licenses") == "") | F.col("content_hash").isNull() | F.col("token_count").isNull()
    return O.manifests(placed(spark, d)).select("shard", F.when(bad, "blocked").otherwise("pass").alias("gate"))


@query("vocab_topk", f"WITH {TOK} SELECT token, n FROM n ORDER BY n DESC, token LIMIT 1000")
def vocab_topk(spark, d):
    return counts(spark, d).orderBy(F.col("n").desc(), "token").limit(1000)


@query("vocab_remap_coverage", f"WITH {TOK}, r AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS new_id FROM (SELECT * FROM n ORDER BY n DESC, token LIMIT 996)) SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN new_id IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS covered, round(sum(CASE WHEN new_id IS NOT NULL THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS coverage, CAST(max(new_id) AS INTEGER) AS largest_id FROM n LEFT JOIN r USING (token)")
def vocab_remap_coverage(spark, d):
    n = counts(spark, d)
    got = F.sum(F.when(F.col("new_id").isNotNull(), F.col("n")).otherwise(0))
    return n.join(O.remap(n, 1000).drop("n"), "token", "left").agg(
        F.sum("n").alias("tokens"), got.alias("covered"), F.round(got / F.sum("n"), 6).alias("coverage"), F.max("new_id").alias("largest_id")
    )


@query("vocab_cap_rank", f"WITH {TOK}, k AS (SELECT token FROM n ORDER BY n DESC, token LIMIT 200) SELECT token, CAST(row_number() OVER (ORDER BY token) AS INTEGER) AS new_id FROM k")
def vocab_cap_rank(spark, d):
    """The variant that numbers the kept tokens by their old order; 0 stays for the unknown."""
    kept = counts(spark, d).orderBy(F.col("n").desc(), "token").limit(200).select("token")
    return kept.withColumn("new_id", F.row_number().over(Window.orderBy("token")))


SUPPLY = f"{PLACED}, s AS (SELECT lang AS lane, source || '-' || lang AS shard, CAST(sum(n_tokens) AS BIGINT) AS tokens, CASE WHEN source < 'src15' THEN 'A' ELSE 'B' END AS tier FROM o GROUP BY lang, source)"


def supply(spark, d):
    p = placed(spark, d).groupBy("lang", "source").agg(F.sum("n_tokens").alias("tokens"))
    return p.select(F.col("lang").alias("lane"), F.concat_ws("-", "source", "lang").alias("shard"), "tokens", F.when(F.col("source") < "src15", "A").otherwise("B").alias("tier"))


@query("reserve_take", f"WITH {SUPPLY}, w AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY lane ORDER BY tier, tokens DESC, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY lane ORDER BY tier, tokens DESC, shard) AS r, count(*) OVER (PARTITION BY lane) AS n, 0.03 * 1.15 * sum(tokens) OVER (PARTITION BY lane) AS want FROM s) SELECT lane, shard, tokens FROM w WHERE before < want AND r <= n - 1")
def reserve_take(spark, d):
    s = supply(spark, d)
    return O.reserve(s, s.groupBy("lane").agg((F.sum("tokens") * 0.03 * 1.15).alias("want")))


@query("supply_by_lane", f"WITH {SUPPLY} SELECT lane, count(*) AS shards, CAST(sum(tokens) AS BIGINT) AS tokens FROM s GROUP BY lane")
def supply_by_lane(spark, d):
    return supply(spark, d).groupBy("lane").agg(F.count("*").alias("shards"), F.sum("tokens").alias("tokens"))
