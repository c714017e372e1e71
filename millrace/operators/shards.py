"""Shards of documents: assignment, offsets, manifests, admission, vocabulary remap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import words

DOCS_PER_SHARD = 20
#: Licences that may be trained on.
LICENSES = ["mit", "apache-2.0", "bsd-3-clause", "bsd-2-clause", "isc", "unlicense", "cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0", "odc-by-1.0", "public-domain", "per-row"]
UNKNOWN, BOS, EOS, PAD = 0, 1, 2, 3


def tokens(text: Column) -> Column:
    """Word tokens with an end mark: what shards hold where no tokenizer file is given."""
    return F.concat(words(text), F.array(F.lit("</s>")))


def assign(docs: DataFrame, group: str = "source", per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Adds shard (group.number) and sample_index: per_shard documents in a row by doc_id."""
    at = F.row_number().over(Window.partitionBy(group).orderBy("doc_id")) - 1
    return docs.withColumn("at_", at).withColumns({
        "shard": F.concat_ws(".", F.col(group), F.lpad(F.floor(F.col("at_") / per_shard).cast("string"), 4, "0")), "sample_index": F.col("at_") % per_shard,
    }).drop("at_")


def offsets(shards: DataFrame) -> DataFrame:
    """Adds n_tokens, token_start and token_end within the shard."""
    run = Window.partitionBy("shard").orderBy("sample_index")
    counted = shards.withColumn("n_tokens", F.size(tokens(F.col("text"))).cast("long"))
    return counted.withColumn("token_end", F.sum("n_tokens").over(run)).withColumn("token_start", F.col("token_end") - F.col("n_tokens"))


def manifests(placed: DataFrame) -> DataFrame:
    """A row for each shard: its documents, languages, licences, counts and content digest."""
    h = F.struct("sample_index", F.sha2("text", 256).alias("h"))
    content = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(h)), lambda s: s["h"]), ""), 256)
    return placed.groupBy("shard").agg(
        F.count("*").alias("n_samples"), F.sum("n_tokens").alias("token_count"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"),
        F.array_join(F.array_sort(F.collect_set(F.lower(F.coalesce("license", F.lit("unknown"))))), ",").alias("licenses"), content.alias("content_hash"),
    )


def admission(m: DataFrame) -> DataFrame:
    """verdict and reasons, in order, of manifests (token_count, licenses, statuses)."""
    bad = F.array_except(F.split("licenses", ","), F.array(*[F.lit(x) for x in LICENSES]))
    ok = ["clean", "pending"]
    reasons = F.filter(F.array(
        F.when(~F.col("tokenizer_ok"), "tokenizer_hash_mismatch"), F.when(~F.col("lineage_ok"), "unknown_cleaning_lineage"),
        F.when(F.size(bad) > 0, F.concat(F.lit("unsafe_license:"), F.array_join(bad, ","))),
        F.when(~F.col("overlap_status").isin(ok), F.concat(F.lit("eval_overlap:"), "overlap_status")),
        F.when(~F.col("contamination_status").isin(ok), F.concat(F.lit("contaminated:"), "contamination_status")),
        F.when(F.col("never_train"), "never_train_flag"), F.when(F.col("duplicate"), "duplicate"), F.when(F.col("token_count") == 0, "empty_shard"),
    ), lambda r: r.isNotNull())
    return m.withColumn("reasons", F.array_join(reasons, ";")).withColumn("verdict", F.when(F.col("reasons") == "", "admitted").otherwise("rejected"))


def remap(counts: DataFrame, size: int, specials: int = 4) -> DataFrame:
    """(token, new_id): the most frequent tokens after the specials; a top-k, not a global sort of all."""
    top = counts.orderBy(F.col("n").desc(), "token").limit(size - specials)
    return top.withColumn("new_id", F.row_number().over(Window.orderBy(F.col("n").desc(), "token")) + specials - 1)


def reserve(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shards (lane, shard, tier, tokens) that each lane sets aside: tier A first, then the larger,
    until the lane's want is met; never a lane's last shard."""
    order = Window.partitionBy("lane").orderBy(F.when(F.col("tier") == "A", 0).otherwise(1), F.col("tokens").desc(), "shard")
    ranked = shards.withColumns({
        "before": F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "rank": F.row_number().over(order),
        "n": F.count("*").over(Window.partitionBy("lane")),
    })
    return ranked.join(wanted, "lane").where("before < want AND rank <= n - 1").select("lane", "shard", "tokens")
