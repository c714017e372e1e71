"""Evaluation firewall: n-gram fingerprints, an inverted index, scans and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let, match_form

#: N-gram words, hits that flag a document, most documents of a fingerprint; windows.
GRAM, MIN_HITS, MAX_DOCS = 8, 5, 3
WINDOW, STRIDE = 120, 40
CANARY = "CANARY-a4b7-do-not-train-9f2e"


def fingerprints(text: Column, n: int = GRAM) -> Column:
    """16 hex digits of sha256 of each n words in a row; of all words if there are fewer; none for none."""
    digest = lambda c: F.substring(F.sha2(c, 256), 1, 16)

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: digest(F.array_join(F.slice(w, i, n), " ")))
        all_of_it = F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array(digest(F.array_join(w, " "))))
        return F.array_distinct(F.when(F.size(w) >= n, many).otherwise(all_of_it))

    return let(F.filter(F.split(match_form(text), " "), lambda x: x != ""), of)


def index(registry: DataFrame, n: int = GRAM) -> DataFrame:
    """(fp, reg_id) of every registered document (doc_id, text)."""
    return registry.select(F.col("doc_id").alias("reg_id"), F.explode(fingerprints(F.col("text"), n)).alias("fp"))


def prune(entries: DataFrame, most: int = MAX_DOCS) -> DataFrame:
    """Without fingerprints of more than so many documents: boilerplate, and the hot keys of the join."""
    kept = entries.groupBy("fp").agg(F.countDistinct("reg_id").alias("df")).where(F.col("df") <= most)
    return entries.join(kept.select("fp"), "fp", "left_semi")


def hits(docs: DataFrame, registry: DataFrame, n: int = GRAM, most: int = MAX_DOCS) -> DataFrame:
    """(doc_id, reg_id, n): distinct fingerprints that a document shares with a registered one."""
    own = docs.select("doc_id", F.explode(fingerprints(F.col("text"), n)).alias("fp"))
    return own.join(prune(index(registry, n), most), "fp").groupBy("doc_id", "reg_id").agg(F.count("*").alias("n"))


def windows(df: DataFrame, key: str) -> DataFrame:
    """(key, w): digests of windows of WINDOW characters at every STRIDE."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.length("text") - WINDOW) - 1, F.lit(STRIDE))
    return df.select(key, F.explode(F.transform(starts, lambda i: F.sha1(F.substring(F.col("text"), i + 1, F.lit(WINDOW))))).alias("w"))


def splice(text: Column, planted: Column, where: float = 0.5) -> Column:
    """A text with another put into it: the attack that scans are tried with."""
    at = F.floor(F.length(text) * where).cast("int")
    return F.concat(F.substring(text, F.lit(1), at), F.lit("\n"), planted, F.lit("\n"), F.substring(text, at + 1, F.length(text)))
