"""The registered queries of the operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.oracles import ORACLES as ORACLES
from siltstone.llm.shared import crc32_mod, read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.quality_rules import quality_rules

    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.substring_dedup import substring_dedup

    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _tokenizer() -> str:
    """The public vocabulary file; the operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _held_out(column: str = "doc_id"):
    """The fold whose labels are never learnt from."""
    return crc32_mod(F.col(column), 4) == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import language_id

    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~_held_out()))
    out = language_id.language_id(docs.select("doc_id", "text"), model)
    return out.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.token_output import token_files

    return token_files(read(spark, sf_dir, "documents"), _tokenizer())


def op5_model(spark: SparkSession, sf_dir: str, **options):
    """The model of op5_toxicity."""
    from siltstone.llm import toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit(docs, read(spark, sf_dir, "labels").where(~_held_out()), **options)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import toxicity

    out = toxicity.toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), op5_model(spark, sf_dir))
    return out.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import mixing

    rows = mixing.sized(read(spark, sf_dir, "documents"))
    return mixing.take(rows, mixing.plan(rows)).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.decontamination import decontamination

    out = decontamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import sharding
    from siltstone.llm.shared import stored

    docs = read(spark, sf_dir, "documents")
    text = F.col("text")
    narrow = docs.select("doc_id", "source", "lang", sharding.size_of(text).alias("size"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), sharding.group_of(text).alias("__grp"))
    narrow = stored(narrow, "shard-rows")
    out = sharding.sharding(narrow.withColumn("__bytes", F.col("size")), 40)
    out = sharding.with_slots(out, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.minhash_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_token_output": op4_token_output,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
}
