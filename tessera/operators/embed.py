"""Embedding: a deterministic default, and embedding only what isn't stored yet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import content_hash, terms
from tessera.session import bounded


def hashed_embedding(rows: DataFrame, dim: int = 64, text: str = "text") -> DataFrame:
    """``id, vector`` for each row of ``rows(id, text)``: signed hashed term counts at length one.

    A term goes to the bucket of the first eight hex digits of its md5, with the sign of the
    next one. Rows without a term get a zero vector. Terms are split natively, each distinct
    one of a batch is hashed once, and a row's counts never leave its task.
    """
    return _embedded(rows.select("id", terms(F.col(text)).alias("_terms")), dim)


def with_embedding(rows: DataFrame, dim: int = 64, text: str = "text") -> DataFrame:
    """``rows`` with the ``vector`` of ``hashed_embedding``, in the same pass: nothing has to be joined by id."""
    return _embedded(rows.withColumn("_terms", terms(F.col(text))), dim)


def _embedded(rows: DataFrame, dim: int) -> DataFrame:
    """``rows`` with a ``vector`` in place of ``_terms``."""
    kept = [f for f in rows.schema if f.name != "_terms"]
    names = [f.name for f in kept]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_terms")
            coded = lists.flatten().dictionary_encode()
            digests = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in coded.dictionary.to_pylist()]
            bucket = np.fromiter((int.from_bytes(d[:4], "big") % dim for d in digests), np.int64, len(digests))
            sign = np.fromiter((1 - 2 * (d[4] >> 4 & 1) for d in digests), np.float64, len(digests))
            codes = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            cells = np.bincount(row * dim + bucket[codes], sign[codes], batch.num_rows * dim).reshape(-1, dim)
            length = np.sqrt((cells**2).sum(axis=1, keepdims=True))
            vectors = cells / np.where(length > 0, length, 1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=[*names, "vector"])

    return bounded(rows).mapInArrow(fold, T.StructType([*kept, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def split_by_cache(rows: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text the cache ``(model, text_hash, vector)`` has, with vectors, and the rest."""
    keyed = rows.withColumn("text_hash", content_hash(F.col("text")))
    own = cache.filter(F.col("model") == model)
    return keyed.join(own.select("text_hash", "vector"), "text_hash"), keyed.join(own.select("text_hash"), "text_hash", "left_anti")


def embed_with_cache(rows: DataFrame, cache: DataFrame, model: str, embedder: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Vectors of all rows, and the entries to add to the cache; each distinct text is embedded once."""
    hits, misses = split_by_cache(rows, cache, model)
    once = misses.groupBy("text_hash").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id"))
    made = once.select("id", "text_hash").join(embedder(once.select("id", "text")), "id").select("text_hash", "vector")
    filled = misses.join(made, "text_hash", "left")
    return hits.select("id", "vector").union(filled.select("id", "vector")), made.select(F.lit(model).alias("model"), "text_hash", "vector")


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Hits, misses and hit rate (0 without lookups) of ``lookups(hit)``, and the entries' bytes if given."""
    hits = F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).cast("long")
    return lookups.agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.when(F.count("*") > 0, hits / F.count("*")).otherwise(0.0).alias("hit_rate"))
