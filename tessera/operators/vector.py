"""Exact nearest neighbours of a batch of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import bounded, ship, write_table

#: Queries in a block: a block is compared with a batch of vectors as one matrix product.
QUERY_BLOCK = 512
#: Query vectors up to so many bytes go to every task; above, blocks of them meet blocks of vectors in a join.
QUERY_BYTES = 64 * 1024 * 1024


def dot(one: Column, two: Column) -> Column:
    """Inner product in double, term by term from the left."""
    products = F.zip_with(one, two, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(one: Column, two: Column) -> Column:
    return dot(one, two) / (norm(one) * norm(two))


def scores_of(queries: np.ndarray, matrix: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        squares = (queries**2).sum(axis=1)[:, None] + (matrix**2).sum(axis=1)[None] - 2 * queries @ matrix.T
        return -np.sqrt(np.maximum(squares, 0))
    if metric == "cosine":
        queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    return queries @ matrix.T


def pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``q, v``: each block of QUERY_BLOCK queries beside each batch of vectors, as lists of structs of all their columns.

    Rows whose ``vector`` is null take no part. Blocks and batches meet in slots, as many as
    the batches ask for.
    """
    packed = queries.filter(F.col("vector").isNotNull()).withColumn("_block", F.floor(F.monotonically_increasing_id() / QUERY_BLOCK))
    blocks = packed.groupBy("_block").agg(F.collect_list(F.struct(*queries.columns)).alias("q"))
    batches_of = vectors.filter(F.col("vector").isNotNull())
    rows = batches_of.withColumn("_batch", F.floor(F.monotonically_increasing_id() / 2048)).groupBy("_batch").agg(F.collect_list(F.struct(*vectors.columns)).alias("v"))
    slots = max(1, -(-vectors.count() // (2048 * 4)))
    left = blocks.select("q", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    right = rows.select("v", F.pmod(F.xxhash64("_batch"), F.lit(slots)).cast("int").alias("slot"))
    return left.join(right, "slot").select("q", "v")


def best_of(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of parts (query, id, score) the ``k`` best of each query, ties by id."""
    query, ids, scores = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], scores[keep]


def compared(queries: np.ndarray, v: pa.Array, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, id and score of the ``k`` best of some vectors for each query."""
    matrix = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    scores = np.round(scores_of(queries, matrix, metric), 6)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return np.repeat(np.arange(len(queries)), order.shape[1]), ids[order].ravel(), np.take_along_axis(scores, order, 1).ravel()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine") -> DataFrame:
    """``query_id, id, score, rank`` of the ``k`` best of ``vectors(id, vector)``, ties by id.

    Where the vectors of ``queries(query_id, vector)`` have QUERY_BYTES or less, they go to
    every task; it compares its own vectors with them in place, batch by batch as a matrix
    product, and hands on the best ``k`` of each query. No vector is shuffled. Beyond that size
    blocks of QUERY_BLOCK queries meet batches of vectors in a join (``pairs``). Metrics: cosine,
    dot, l2 (score is the negative distance). Null vectors take no part.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(metric)
    ship(vectors.sparkSession)
    asked = write_table(queries.filter(F.col("vector").isNotNull()).select("query_id", "vector"), "queries")
    size = asked.agg(F.sum(F.size("vector").cast("long") * 8 + 16)).first()[0] or 0
    vectors = vectors.filter(F.col("vector").isNotNull()).select("id", "vector")

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shipped.value
        if not len(matrix):
            return
        held = []
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                for q in range(0, len(matrix), QUERY_BLOCK):
                    query, ids, scores = compared(matrix[q : q + QUERY_BLOCK], part.column("vector"), part.column("id").to_numpy(zero_copy_only=False), k, metric)
                    held.append((query + q, ids, scores))
                held = [best_of(held, k)]
        if held:
            query, ids, scores = held[0]
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(ids), pa.array(scores)], names=["query_id", "id", "score"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = batch.column("q")[i].values, batch.column("v")[i].values
                names = q.field("query_id").to_numpy(zero_copy_only=False)
                matrix = q.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1)
                query, ids, scores = compared(matrix, v.field("vector"), v.field("id").to_numpy(zero_copy_only=False), k, metric)
                yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(ids), pa.array(scores)], names=["query_id", "id", "score"])

    schema = "query_id bigint, id bigint, score double"
    if size <= QUERY_BYTES:
        own = asked.toArrow()
        names = own.column("query_id").to_numpy()
        lists = own.column("vector").combine_chunks()
        matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1) if len(names) else np.zeros((0, 1))
        shipped = vectors.sparkSession.sparkContext.broadcast((names, matrix))
        found = bounded(vectors).mapInArrow(in_place, schema)
    else:
        found = bounded(pairs(vectors, asked)).mapInArrow(met, schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
