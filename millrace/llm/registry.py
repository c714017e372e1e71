"""The queries of this subpackage, with the parameters they run with, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import fingerprints, grammar, jaccard, langid, mixing, oracles, packing, secretscan, suffix, topk, urls
from millrace.llm.common import load


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.read(spark, grammar.write(spark, load(spark, sf_dir, "documents"), tokenizer_path()))


#: The rules that op2 judges by.
RULES = [
    urls.Rule("com", "/", "allow"),
    urls.Rule("example.com", "/en/", "block"),
    urls.Rule("www.example.com", "/en/", "allow"),
    urls.Rule("net", "/es/", "block"),
    urls.Rule("net", "/fr/", "block"),
]


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, load(spark, sf_dir, "pages"), RULES)


def op3_suffix_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove(spark, load(spark, sf_dir, "documents"), keep=["doc_id"])
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, load(spark, sf_dir, "embeddings"), query_modulus=50, k=5)


def op5_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, load(spark, sf_dir, "documents"), weights=[1, 2, 3], max_epochs=3)


def op6_quartile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(spark, load(spark, sf_dir, "documents"))


def op7_multipart_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(secretscan.scan(spark, load(spark, sf_dir, "documents"), keep=["doc_id"]))


def op8_minhash_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark, load(spark, sf_dir, "documents"), keep=["doc_id"]).drop("first")


def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    apart = langid.held_out(F.col("doc_id"))
    prototypes = langid.learn(spark, docs.where(~apart).select("text", "lang"))
    return langid.predict(spark, docs.select("doc_id", apart.alias("held_out"), "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op10_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, load(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repair_token_files": op1_repair_token_files,
        "op2_redirect_equivalence": op2_redirect_equivalence,
        "op3_suffix_automaton_dedup": op3_suffix_automaton_dedup,
        "op4_impact_ordered_topk": op4_impact_ordered_topk,
        "op5_capped_water_filling": op5_capped_water_filling,
        "op6_quartile_digests": op6_quartile_digests,
        "op7_multipart_credentials": op7_multipart_credentials,
        "op8_minhash_forest_join": op8_minhash_forest_join,
        "op9_hyperdimensional_language": op9_hyperdimensional_language,
        "op10_bounded_space_packing": op10_bounded_space_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_redirect_equivalence": oracles.op2(RULES),
        "op3_suffix_automaton_dedup": oracles.OP3,
        "op4_impact_ordered_topk": oracles.OP4,
        "op5_capped_water_filling": oracles.OP5,
        "op8_minhash_forest_join": oracles.OP8,
    }
