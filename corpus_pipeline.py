"""The corpus pipeline: five stages over the documents, each a table for the next.

1. language: documents whose language can't be told (no text, no letter) go;
2. near_duplicates: of each group of documents with similar word 5-grams, one stays;
3. secrets: secrets and linked credentials are masked in the texts;
4. mixing: sources are repeated or thinned to their target weights;
5. packing: the texts' token ids are packed into sequences of 1024.

Every stage but the last returns the columns of documents; other columns of its input, whatever
their names, go.  Each takes whatever its predecessor kept, an empty table included, reads texts
whole, and treats rows that share a doc_id, or have none, as documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, langid, mixing, packing, secretscan
from millrace.llm.common import clear, drop_table, load, materialize, written
from millrace.llm.registry import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects und: null texts and texts without a letter.  lang becomes the predicted language.

    Profiles are learned from the documents that op9 learns from.  Null languages teach nothing, but their texts are
    told like any other; where nothing can be learned all documents are und, and go.  Ties go to the smaller language."""
    docs = docs.select(*COLUMNS)
    prototypes = langid.learn(spark, docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    told = langid.predict(spark, docs, prototypes).where(F.col("lang_pred") != langid.UNKNOWN)
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 or more connect, the document with the least doc_id stays.

    Of rows that repeat that doc_id one stays; a null doc_id comes after all others.  Texts without words, null ones
    included, have no links and stay."""
    return jaccard.join(spark, docs, keep=COLUMNS).where("first").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every reported span; n_chars follows the text.  Rows stay, in number and order of nothing else; null texts
    stay null, with n_chars null."""
    masked = secretscan.redact(secretscan.scan(spark, docs, keep=COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn, at most 3 epochs; a document taken twice is there twice, one taken in part with
    its first words.  The null source is a source, the last.  Texts without words take nothing and go."""
    mixed = mixing.mix(spark, docs, weights=[1, 2, 3], max_epochs=3, keep=COLUMNS)
    return mixing.repeated(mixed, COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of op10: each row's ids and an end id, in sequences of 1024; a null text is the end id alone."""
    return packing.pack(spark, docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Learned profiles, MinHash groups and token ids are not expressible in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = written()
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage_{name}")
        clear(spark, before, keep=docs)  # what the stage itself wrote, and what it read
        if last is not None:
            drop_table(spark, last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
