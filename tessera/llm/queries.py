"""The registered queries of this subpackage, one per operator, and their oracles."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, forced_bpe, hard_negatives, hmm, language_id, mixing, piece_counts, prefix_trie, quality, repeated_spans, simhash, token_files, topk
from tessera.llm.common import read_table


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read_table(spark, sf_dir, "documents"), hmm.held_out())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.report(decontaminate.contained_items(docs, items))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).report()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = piece_counts.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    return piece_counts.count_tokens(read_table(spark, sf_dir, "documents"), pieces)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.report(docs, language_id.train(docs, ~language_id.held_out()))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(simhash.near_duplicates(read_table(spark, sf_dir, "documents")))


def tokenizer_json() -> str:
    """The vocabulary file's text, read on the driver and shipped to the tasks (its size is fixed)."""
    return Path(tokenizer_path("byte_bpe_50k.json")).read_text()


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(token_files.write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_json()))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.report(docs, quality.train(docs, read_table(spark, sf_dir, "labels"), ~quality.held_out()))


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return repeated_spans.report(docs, repeated_spans.repeated_spans(docs))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = tokenizer_json()
    return forced_bpe.report(forced_bpe.encode(read_table(spark, sf_dir, "documents"), json), json)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_hmm_scores": op1_hmm_scores,
    "op2_decontaminate": op2_decontaminate,
    "op3_mix_sources": op3_mix_sources,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_top_k": op6_top_k,
    "op7_simhash": op7_simhash,
    "op8_token_files": op8_token_files,
    "op9_quality": op9_quality,
    "op10_repeated_spans": op10_repeated_spans,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {"op2_decontaminate": decontaminate.ORACLE, "op3_mix_sources": mixing.ORACLE, "op6_top_k": topk.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
