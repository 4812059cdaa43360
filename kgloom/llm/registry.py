"""Queries of the corpus operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import common, exact_dedup, language, merkle, mixing, packing, prefix_trie, quality, sharding, simhash, simple8b, spotsigs, token_counts, toxicity

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE)))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.written(quality.features(table(spark, sf_dir, "documents")), "features")
    return quality.score(pages, quality.fit(pages, table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by the fingerprints of op5_spotsigs: their class, whole table."""
    return spotsigs.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = simple8b.write_files(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))
    return simple8b.digest(simple8b.read_files(files))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.groups(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.sections(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(exact_dedup.annotate(table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(table(spark, sf_dir, "conversations"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_sharding": op2_sharding,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_spotsigs": op5_spotsigs,
        "op6_mixing": op6_mixing,
        "op7_simple8b": op7_simple8b,
        "op8_simhash": op8_simhash,
        "op9_token_counts": op9_token_counts,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_language": op13_language,
        "spotsigs_classes": spotsigs_classes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": exact_dedup.SQL, "op11_merkle_manifest": merkle.SQL, "op12_prefix_trie": prefix_trie.SQL}
