"""The corpus pipeline: from raw documents to token files, stage by stage.

Each stage works on everything that the one before it kept, columns of any name pass
through, and very long texts are taken whole. What a stage returns is
written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language_id, mixing, simhash, token_files
from tessera.llm.common import read_table
from tessera.llm.queries import tokenizer_json
from tessera.session import write_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the character models recognise; the rejected ones go.

    Null texts and texts without letters are rejected; equal texts share their fate, repeated
    rows stay repeated; with no language learned nothing stays; an empty table stays empty.
    """
    return language_id.keep_identified(docs, language_id.train(docs, ~language_id.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the least id, then text hash, then the other columns.

    Null and empty texts are near-duplicates of each other; a null id is the last choice; an
    empty table stays empty.
    """
    return simhash.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null texts contain nothing and stay; repeated rows stay repeated; without items all stay.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the sources' target weights ask for.

    Null sources are one source; null and empty texts have size 0; rows that repeat an id share
    the draw; an empty table stays empty.
    """
    return mixing.mix(docs).emit_copies()


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; per document its place in them, its length and checksum.

    Null texts are an end alone; null ids come first; each of repeated rows is a document; an
    empty table gives empty files.
    """
    return token_files.report(token_files.write_tokens(docs, tokenizer_json()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("clean_of_benchmark", clean_of_benchmark),
    ("mixed", mixed),
    ("tokens", tokens),
]

#: Language ID and tokenization can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
