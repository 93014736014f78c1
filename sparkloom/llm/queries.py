"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chat, compression, decontamination, divergence, fingerprints, mixing, neardup, quality, rules, substrings, tokens, urls, warc
from sparkloom.llm.oracles import ORACLE_SQL  # noqa: F401
from sparkloom.session import spread, table


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a table of fewer partitions than cores is dealt to all of them."""
    return spread(table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(documents(spark, sf_dir), length=200).drop("text", "kept_text", "spans")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), tokenizer(), limit=4096)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("places")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_chats(chat.format_chats(rows))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.mine_rules(urls.labelled_urls(pages, table(spark, sf_dir, "labels"))))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).drop("url", "payload")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(documents(spark, sf_dir))


def op12_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compress(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(rules.measure(documents(spark, sf_dir))).drop("failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_substrings": op2_substrings,
    "op3_token_counts": op3_token_counts,
    "op4_neardup": op4_neardup,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_chat": op8_chat,
    "op9_urls": op9_urls,
    "op10_warc": op10_warc,
    "op11_divergence": op11_divergence,
    "op12_compression": op12_compression,
    "op13_quality_rules": op13_quality_rules,
}
