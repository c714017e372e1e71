"""Cleaning: normalisation, markers, language, quality, personal data, the funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.clean import drop_reasons, funnel, masked_documents
from millrace.plans import firewall
from millrace.plans.base import query
from millrace.session import importable
from millrace.sources.tables import table

# ---- pieces of DuckDB SQL that several oracles use ----
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
LINES = r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))"
NOISE = "[" + T.NOISE + "]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{7f}-\x{9f}]"
NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '{NOISE}', '', 'g'), '{CONTROL}', '', 'g'), '[ \t\x{{a0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
GHOST = T.GHOST.replace("'", "''")
EMAIL = r"[0-9A-Za-z_][0-9A-Za-z_.+-]*@[0-9A-Za-z_-]+\.[0-9A-Za-z_.-]*[0-9A-Za-z_]"
QUALITY = rf"""
q AS (SELECT *, len(w) AS n, len(ln) AS k,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS letters,
        len(regexp_extract_all(text, '[#…]')) AS symbols,
        len(regexp_extract_all(text, '\p{{Latin}}')) AS latin, length(regexp_replace(text, '\s', '', 'g')) AS visible,
        len(list_filter(ln, lambda x: regexp_matches(regexp_replace(x, '\s+$', ''), '[.?!।॥]$'))) AS ends,
        len(list_filter(ln, lambda x: regexp_matches(regexp_replace(x, '\s+$', ''), '[.?!]$'))) AS ends_en,
        len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), {T.STOP_WORDS!r})) AS stops
      FROM (SELECT doc_id, lang, source, text, {WORDS} AS w, {LINES} AS ln FROM documents)),
r AS (SELECT *, CASE WHEN n < 20 THEN 'too_short' WHEN k > 0 AND 1 - len(list_distinct(ln))::DOUBLE / k > 0.30 THEN 'dup_lines'
        WHEN symbols::DOUBLE / n > 0.10 THEN 'symbol_ratio' WHEN letters::DOUBLE / n < 2.5 OR letters::DOUBLE / n > 12 THEN 'word_len'
        WHEN k > 0 AND ends::DOUBLE / k < 0.10 THEN 'no_terminal_punct' WHEN (CASE WHEN visible > 0 THEN latin::DOUBLE / visible ELSE 0 END) < 0.40 THEN 'low_script' END AS reason,
      CASE WHEN n < 20 THEN 'too_short' WHEN k > 0 AND 1 - len(list_distinct(ln))::DOUBLE / k > 0.30 THEN 'dup_lines'
        WHEN symbols::DOUBLE / n > 0.10 THEN 'symbol_ratio' WHEN letters::DOUBLE / n < 3 OR letters::DOUBLE / n > 10 THEN 'word_len_en'
        WHEN stops < 2 THEN 'no_stopwords_en' WHEN k > 0 AND ends_en::DOUBLE / k < 0.15 THEN 'no_terminal_punct_en' END AS reason_en FROM q)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("clean_normalize", f"SELECT doc_id, md5({NORMAL}) AS normal_md5, CAST(len(regexp_extract_all(text, '{NOISE}')) + len(regexp_extract_all(text, '{CONTROL}')) AS BIGINT) AS garbage FROM documents")
def clean_normalize(spark, d):
    importable(spark)
    return docs(spark, d).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal_md5"), T.garbage(F.col("text")).alias("garbage"))


@query("clean_ghost", f"SELECT doc_id, CAST(len(regexp_extract_all(t, '{GHOST}')) AS BIGINT) AS ghosts, md5(regexp_replace(t, '{GHOST}', ' ', 'g')) AS clean_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<|im_start|>' || text || ' [/INST] ### Human: <s>' ELSE text END AS t FROM documents)")
def clean_ghost(spark, d):
    """Every third text gets markers first, as the tables have none."""
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<|im_start|>"), "text", F.lit(" [/INST] ### Human: <s>"))).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", t.alias("t")).select(
        "doc_id", F.regexp_count("t", F.lit(T.GHOST)).cast("long").alias("ghosts"), F.md5(T.strip_ghosts(F.col("t"))).alias("clean_md5")
    )


@query("clean_ghost_prose", f"SELECT doc_id, md5(CASE WHEN source IN ('src1', 'src2') THEN regexp_replace(t, '{T.GHOST_PROSE}', ' ', 'g') ELSE t END) AS clean_md5 FROM (SELECT doc_id, source, '<s>' || text || '<|sys|>' AS t FROM documents)")
def clean_ghost_prose(spark, d):
    """The marker rules of prose lanes; other lanes keep theirs."""
    t = F.col("t")
    return docs(spark, d).select("doc_id", "source", F.concat(F.lit("<s>"), "text", F.lit("<|sys|>")).alias("t")).select(
        "doc_id", F.md5(F.when(F.col("source").isin("src1", "src2"), T.strip_ghosts(t, T.GHOST_PROSE)).otherwise(t)).alias("clean_md5")
    )


@query("clean_script_ratio", r"SELECT doc_id, round(CASE WHEN v > 0 THEN l::DOUBLE / v ELSE 0 END, 6) AS latin, round(CASE WHEN v > 0 THEN dv::DOUBLE / v ELSE 0 END, 6) AS devanagari FROM (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS v, len(regexp_extract_all(text, '\p{Latin}')) AS l, len(regexp_extract_all(text, '[\x{900}-\x{97f}]')) AS dv FROM documents)")
def clean_script_ratio(spark, d):
    text = F.col("text")
    return docs(spark, d).select(
        "doc_id", F.round(T.script_ratio(text, r"\p{IsLatin}"), 6).alias("latin"), F.round(T.script_ratio(text, r"\p{InDevanagari}"), 6).alias("devanagari")
    )


@query("clean_lang_id", r"SELECT doc_id, CASE WHEN a > 0.5 * n THEN 'mostly_latin' ELSE 'other_script' END AS reason FROM (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[A-Za-z]')) AS a, length(regexp_replace(text, '\s', '', 'g')) AS v, len(regexp_extract_all(text, '[\x{900}-\x{97f}]')) AS dv FROM documents) WHERE (CASE WHEN v > 0 THEN dv::DOUBLE / v ELSE 0 END) < 0.5")
def clean_lang_id(spark, d):
    """Documents that a script gate of 0.50 drops, and why."""
    text = F.col("text")
    reason = F.when(F.regexp_count(text, F.lit("[A-Za-z]")) > 0.5 * F.length(text), "mostly_latin").otherwise("other_script")
    return docs(spark, d).where(T.script_ratio(text, r"\p{InDevanagari}") < 0.5).select("doc_id", reason.alias("reason"))


@query("clean_token_script", r"SELECT doc_id, CASE WHEN c = '' THEN 'NONE' WHEN regexp_matches(c, '\p{Latin}') THEN 'LATIN' WHEN regexp_matches(c, '\p{Devanagari}') THEN 'DEVANAGARI' ELSE 'OTHER' END AS script FROM (SELECT doc_id, regexp_extract(text, '\p{L}') AS c FROM documents)")
def clean_token_script(spark, d):
    """The script of a text's first letter."""
    c = F.regexp_extract("text", r"(\p{L})", 1)
    script = F.when(c == "", "NONE").when(c.rlike(r"\p{IsLatin}"), "LATIN").when(c.rlike(r"\p{IsDevanagari}"), "DEVANAGARI").otherwise("OTHER")
    return docs(spark, d).select("doc_id", script.alias("script"))


@query("clean_quality", f"WITH {QUALITY} SELECT doc_id, reason, reason_en FROM r")
def clean_quality(spark, d):
    return docs(spark, d).select("doc_id", T.quality_reason(F.col("text"), T.LATIN).alias("reason"), T.quality_reason(F.col("text"), T.ENGLISH).alias("reason_en"))


@query("clean_quality_reasons", f"WITH {QUALITY} SELECT lang, coalesce(reason, 'kept') AS reason, count(*) AS docs FROM r GROUP BY ALL")
def clean_quality_reasons(spark, d):
    reason = F.coalesce(T.quality_reason(F.col("text"), T.LATIN), F.lit("kept"))
    return docs(spark, d).groupBy("lang", reason.alias("reason")).agg(F.count("*").alias("docs"))


@query("clean_quality_erasure", f"WITH {QUALITY} SELECT lang, count(*) AS docs, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason_en IS NULL) AS kept_en, count(*) FILTER (reason IS NULL AND reason_en IS NOT NULL) AS erased FROM r GROUP BY lang")
def clean_quality_erasure(spark, d):
    """What rules tuned to English would delete that script-aware rules keep."""
    judged = docs(spark, d).select("lang", T.quality_reason(F.col("text"), T.LATIN).alias("a"), T.quality_reason(F.col("text"), T.ENGLISH).alias("b"))
    return judged.groupBy("lang").agg(
        F.count("*").alias("docs"), F.count_if(F.col("a").isNull()).alias("kept"), F.count_if(F.col("b").isNull()).alias("kept_en"),
        F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("erased"),
    )


@query("clean_pii_email_ip", rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS BIGINT) AS emails, CAST(len(regexp_extract_all(text, '\b(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b')) AS BIGINT) AS ips FROM documents")
def clean_pii_email_ip(spark, d):
    by_name = dict(T.PII)
    return docs(spark, d).select(
        "doc_id", F.regexp_count("text", F.lit(by_name["EMAIL"])).cast("long").alias("emails"), F.regexp_count("text", F.lit(by_name["IP"])).cast("long").alias("ips")
    )


@query("clean_pii_mask")
def clean_pii_mask(spark, d):
    """Masks in order; look-arounds have no SQL twin, so tests hold this against plain Python."""
    return masked_documents(docs(spark, d))


@query("clean_pii_tags", r"SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'))) AS BIGINT) AS ips FROM documents WHERE regexp_matches(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')")
def clean_pii_tags(spark, d):
    """Documents with addresses, counted by their masks."""
    tags = {"EMAIL": "[EMAIL]", "AADHAAR": "[ID]", "PHONE": "[PHONE]", "IP": "[IP]"}
    ip = dict(T.PII)["IP"]
    return docs(spark, d).where(F.col("text").rlike(ip)).select(F.regexp_replace("text", ip, tags["IP"]).alias("t")).agg(
        F.count("*").alias("docs"), F.sum(F.regexp_count("t", F.lit(r"\[IP\]"))).cast("long").alias("ips")
    )


@query("clean_pii_phone", r"SELECT count(*) AS docs FROM documents WHERE regexp_matches(text, '(^|[^0-9])((\+?91[\s-]?)?[6-9][0-9]{9})([^0-9]|$)')")
def clean_pii_phone(spark, d):
    return docs(spark, d).where(F.col("text").rlike(dict(T.PII)["PHONE"])).agg(F.count("*").alias("docs"))


@query("clean_samples", f"WITH {QUALITY} SELECT coalesce(reason, 'kept') AS reason, min(doc_id) AS doc_id, arg_min(md5(substr(text, 1, 200)), doc_id) AS head_md5 FROM r GROUP BY 1")
def clean_samples(spark, d):
    """The first document of every outcome."""
    judged = docs(spark, d).withColumn("reason", F.coalesce(T.quality_reason(F.col("text"), T.LATIN), F.lit("kept")))
    return judged.groupBy("reason").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.md5(F.substring("text", 1, 200)), "doc_id").alias("head_md5"))


@query("clean_token_estimate", r"SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) / 4.0, 2) AS naive_tokens, round(sum(length(text))::DOUBLE / sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))), 6) AS chars_per_word FROM documents GROUP BY lang")
def clean_token_estimate(spark, d):
    return docs(spark, d).groupBy("lang").agg(
        F.sum(F.length("text")).cast("long").alias("chars"), F.round(F.sum(F.length("text")) / 4.0, 2).alias("naive_tokens"),
        F.round(F.sum(F.length("text")) / F.sum(F.size(T.words(F.col("text")))), 6).alias("chars_per_word"),
    )


FUNNEL = rf"""WITH {QUALITY},
x AS (SELECT *, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS copy FROM r),
s AS (SELECT doc_id, n, CASE WHEN visible = 0 OR latin::DOUBLE / visible < 0.5 THEN 1 WHEN reason IS NOT NULL THEN 2 ELSE 3 END AS stage FROM q JOIN r USING (doc_id, n, visible, latin)),
e AS (SELECT r.doc_id, r.n, CASE WHEN s.stage < 3 THEN s.stage WHEN row_number() OVER (PARTITION BY s.stage = 3, sha1(r.text) ORDER BY r.doc_id) > 1 THEN 3 ELSE 4 END AS gone FROM r JOIN s USING (doc_id))
SELECT stage, count(*) FILTER (WHERE gone > cut) AS docs, CAST(coalesce(sum(n) FILTER (WHERE gone > cut), 0) AS BIGINT) AS words, count(*) FILTER (WHERE gone = cut) AS removed_docs
FROM e, (SELECT unnest([0, 1, 2, 3]) AS cut, unnest(['input', 'language', 'quality', 'exact_dedup']) AS stage) GROUP BY stage, cut"""


@query("clean_funnel", FUNNEL)
def clean_funnel(spark, d):
    return funnel(drop_reasons(docs(spark, d)))


@query("label_quality_agreement", f"WITH {QUALITY} SELECT l.quality, l.toxic, count(*) AS docs, count(*) FILTER (reason IS NULL) AS kept FROM r JOIN labels l USING (doc_id) GROUP BY ALL")
def label_quality_agreement(spark, d):
    judged = docs(spark, d).select("doc_id", T.quality_reason(F.col("text"), T.LATIN).alias("reason"))
    return judged.join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.count_if(F.col("reason").isNull()).alias("kept"))


@query("clean_flagship", f"WITH {QUALITY}, {firewall.HITS}, fk AS (SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS rn FROM r WHERE reason IS NULL) WHERE rn = 1), fb AS (SELECT DISTINCT doc_id FROM hit WHERE n >= 5) SELECT lang, docs, kept, clean FROM (SELECT lang, count(*) AS docs FROM documents GROUP BY lang) LEFT JOIN (SELECT lang, count(*) AS kept FROM fk GROUP BY lang) USING (lang) LEFT JOIN (SELECT lang, count(*) AS clean FROM fk WHERE doc_id NOT IN (SELECT doc_id FROM fb) GROUP BY lang) USING (lang)")
def clean_flagship(spark, d):
    """Quality, exact dedup and decontamination against benchmark, as a funnel by language."""
    from millrace.operators.firewall import hits
    from millrace.operators.dedup import first_copies

    kept = first_copies(docs(spark, d).where(T.quality_reason(F.col("text"), T.LATIN).isNull()), "text", "doc_id")
    bad = hits(kept.select("doc_id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).where("n >= 5").select("doc_id").distinct()
    clean = kept.join(bad, "doc_id", "left_anti")
    total = docs(spark, d).groupBy("lang").agg(F.count("*").alias("docs"))
    return total.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").join(clean.groupBy("lang").agg(F.count("*").alias("clean")), "lang", "left")
