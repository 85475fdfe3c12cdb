"""The queries of the numbered operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, conversation_trie, embedding_dedup, exact_dedup, hard_negatives, langid, minhash, mixing, secret_scan, sentence_spans, suffix_dedup, topk, toxicity
from quillon.session import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.report(sentence_spans.dedup(table(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_top_k": op2_top_k,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_bpe": op10_bpe,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {
    "op2_top_k": topk.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op11_conversation_trie": conversation_trie.SQL,
    "op12_embedding_dedup": embedding_dedup.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
