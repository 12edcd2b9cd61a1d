"""The subpackage's queries, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import drop_at_exit, shared_dir, table
from wayfare.llm.decontaminate import contaminated
from wayfare.llm.language import language_digest
from wayfare.llm.licenses import license_matches
from wayfare.llm.mixing import mix_digest
from wayfare.llm.oracles import mix_sql, repair_sql, secrets_sql, seeds_sql
from wayfare.llm.packing import packed
from wayfare.llm.quality import quality
from wayfare.llm.repair import repair_digest
from wayfare.llm.secrets import Ledger, findings_by_version, secret_digest
from wayfare.llm.sharding import shard_digest
from wayfare.llm.simhash import simhash_digest
from wayfare.llm.suffixes import repeated_bytes
from wayfare.llm.tokencount import token_counts
from wayfare.llm.variants import grouped_words

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op3_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def op5_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"), shards=40)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(table(spark, sf_dir, "documents"))


#: The setting that names a lasting ledger's folder; without it each run of the query has a new one.
SECRET_LEDGER = "spark.wayfare.secretLedger"


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = spark.conf.get(SECRET_LEDGER, None)
    if not root:
        root = f"{shared_dir(spark)}.ledger"
        drop_at_exit(spark, root)
    return secret_digest(findings_by_version(Ledger(spark, root).scan(table(spark, sf_dir, "documents"))))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(table(spark, sf_dir, "conversations"))


def op12_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_words(table(spark, sf_dir, "documents"), damaged=True)


QUERIES: dict[str, Query] = {
    "op1_license_alignment": op1_license_alignment,
    "op2_compression_bands": op2_compression_bands,
    "op3_hierarchical_mix": op3_hierarchical_mix,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op5_suffix_merge": op5_suffix_merge,
    "op6_stratified_shards": op6_stratified_shards,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_token_counts": op9_token_counts,
    "op10_gray_simhash": op10_gray_simhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_cutting_stock": op12_cutting_stock,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op3_hierarchical_mix": mix_sql(),
    "op4_spaced_seeds": seeds_sql(),
    "op8_secret_ledger": secrets_sql(),
    "op11_conversation_repair": repair_sql(),
}
