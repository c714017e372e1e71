"""Cleaning of document tables: why a document goes, what is left, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

STAGES = ["input", "language", "quality", "exact_dedup"]


def masked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, masked text's digest and the spans masked of each kind."""
    text, counts = T.masked(F.col("text"))
    return docs.select("doc_id", F.md5(text).alias("masked_md5"), *[c.alias(k.lower()) for k, c in counts.items()])


def drop_reasons(docs: DataFrame, script: str = r"\p{IsLatin}", least: float = 0.5) -> DataFrame:
    """Every document with its words and the stage (index in STAGES) that drops it; len(STAGES) if none does.

    One narrow projection for the first stages; one shuffle, of digests and not of texts, for copies."""
    text = F.col("text")
    stage = F.when(T.script_ratio(text, script) < least, 1).when(T.quality_reason(text, T.LATIN).isNotNull(), 2).otherwise(3)
    slim = docs.select("doc_id", F.size(T.words(text)).alias("n_words"), stage.alias("stage"), F.sha1(text).alias("digest"))
    copy = F.row_number().over(Window.partitionBy(F.col("stage") == 3, "digest").orderBy("doc_id"))
    return slim.withColumn("copy", copy).select("doc_id", "n_words", F.when((F.col("stage") == 3) & (F.col("copy") == 1), len(STAGES)).otherwise(F.col("stage")).alias("gone"))


def funnel(dropped: DataFrame) -> DataFrame:
    """Documents and words after every stage, and what the stage removed: one pass of conditional sums."""
    sums = dropped.agg(
        *[F.count_if(F.col("gone") > i).alias(f"docs{i}") for i in range(len(STAGES))],
        *[F.coalesce(F.sum(F.when(F.col("gone") > i, F.col("n_words"))), F.lit(0)).cast("long").alias(f"words{i}") for i in range(len(STAGES))],
        *[F.count_if(F.col("gone") == i).alias(f"removed{i}") for i in range(len(STAGES))],
    )
    rows = ", ".join(f"'{s}', docs{i}, words{i}, removed{i}" for i, s in enumerate(STAGES))
    return sums.selectExpr(f"stack({len(STAGES)}, {rows}) AS (stage, docs, words, removed_docs)")
