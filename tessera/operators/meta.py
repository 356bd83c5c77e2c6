"""What an index holds: documents, chunks, types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def documents(index: DataFrame) -> DataFrame:
    """Per source its chunks, and the time, type and modification time of its first chunk, newest first."""
    first = F.min_by(F.struct("timestamp", "doc_type", "file_modified"), F.struct("timestamp", "chunk_index"))
    grouped = index.groupBy(F.col("source").alias("document")).agg(F.count("*").alias("chunks"), first.alias("f"))
    listed = grouped.select("document", "chunks", F.col("f.timestamp").alias("indexed_at"), F.col("f.doc_type").alias("type"), F.col("f.file_modified").alias("modified"))
    return listed.orderBy(F.col("indexed_at").desc(), "document")


def counts(index: DataFrame) -> DataFrame:
    """One row: documents, chunks, whole chunks a document (0 for an empty index)."""
    n, chunks = F.count_distinct("source"), F.count("*")
    return index.agg(n.alias("document_count"), chunks.alias("total_chunks"), F.when(n > 0, F.floor(chunks / n)).otherwise(0).cast("long").alias("avg_chunks_per_doc"))


def type_histogram(index: DataFrame) -> DataFrame:
    """Chunks per document type, most first."""
    return index.groupBy("doc_type").agg(F.count("*").alias("chunks")).orderBy(F.col("chunks").desc(), "doc_type")


def rollup(index: DataFrame) -> DataFrame:
    """Chunks and documents per type and overall, in one pass."""
    return index.rollup("doc_type").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("documents"))


def total_chunks(listed: DataFrame) -> DataFrame:
    """Sum of the chunks of ``documents``."""
    return listed.agg(F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("total_chunks"))


def status_counts(statuses: DataFrame) -> DataFrame:
    """Files by change status."""
    return statuses.groupBy("status").agg(F.count("*").alias("files"))


def throughput(files: DataFrame) -> DataFrame:
    """Files, failures, total seconds and files a minute of ``files(source, ok, seconds)``."""
    seconds = F.sum("seconds")
    return files.agg(
        F.count("*").alias("files"), F.count_if(~F.col("ok")).alias("failed"), F.round(seconds, 6).alias("seconds"),
        F.when(seconds > 0, F.round(60 * F.count("*") / seconds, 6)).otherwise(0.0).alias("per_minute"),
    )
