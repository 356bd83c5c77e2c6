"""Schemas of the index's tables."""

from pyspark.sql import types as T

INDEX = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("chunk", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("chunk_hash", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("section_header", T.StringType()),
        T.StructField("file_modified", T.TimestampType()),
        T.StructField("doc_keywords", T.ArrayType(T.StringType())),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("cluster_distance", T.FloatType()),
    ]
)

#: What is known of each source, though all its chunks may be copies of others'.
LEDGER = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("file_modified", T.TimestampType()),
        T.StructField("chunks", T.LongType()),
    ]
)

#: Blocks of the vectors of the chunks.
ANCHORS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("v", T.BinaryType()),
        T.StructField("low", T.ArrayType(T.DoubleType())),
        T.StructField("high", T.ArrayType(T.DoubleType())),
    ]
)
