"""Clusters of vectors: fitting, assignment, and pruning a search to the nearest ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kmeans, vector
from tessera.operators.vector import dot
from tessera.session import bounded, write_table


def label_centroids(vectors: DataFrame) -> DataFrame:
    """``cluster_id, centroid``: the mean vector of each label."""
    parts = vectors.select("label", F.posexplode("vector").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    listed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    return listed.select(F.col("label").alias("cluster_id"), F.transform("cells", lambda c: c["x"]).alias("centroid"))


def distances(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``vectors`` with ``d``: an array of (distance, cluster_id), nearest first.

    The centroids (a model of a given number of clusters) go along as one row's array.
    """
    model = centroids.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "centroid"))).alias("model"))
    joined = vectors.join(F.broadcast(model), how="cross")  # one row
    far = lambda c: F.round(F.sqrt(dot(_minus(F.col("vector"), c["centroid"]), _minus(F.col("vector"), c["centroid"]))), 6)
    ranked = F.array_sort(F.transform("model", lambda c: F.struct(far(c).alias("distance"), c["cluster_id"].alias("cluster_id"))))
    return joined.withColumn("d", ranked).drop("model")


def _minus(one, two):
    return F.zip_with(one, two, lambda a, b: a.cast("double") - b.cast("double"))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``vectors`` with ``cluster_id, cluster_distance`` of the nearest centroid, ties to the smaller id."""
    near = distances(vectors, centroids)
    return near.withColumn("cluster_id", F.col("d")[0]["cluster_id"]).withColumn("cluster_distance", F.col("d")[0]["distance"]).drop("d")


def nearest_clusters(queries: DataFrame, centroids: DataFrame, top_k: int = 2) -> DataFrame:
    """``query_id, cluster_id, distance, rank`` of the nearest ``top_k`` clusters of each query."""
    near = distances(queries, centroids).select("query_id", F.posexplode(F.slice("d", 1, top_k)).alias("pos", "c"))
    return near.select("query_id", "c.cluster_id", "c.distance", (F.col("pos") + 1).alias("rank"))


def prune(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, top_k: int = 2) -> DataFrame:
    """``query_id`` and the rows of the clusters nearest to it; all rows where there is one cluster."""
    return nearest_clusters(queries, centroids, top_k).select("query_id", "cluster_id").join(assigned, "cluster_id")


def store(assigned: DataFrame, path: str) -> DataFrame:
    """Write ``assigned`` by ``cluster_id``, a folder each, so that a search reads only the folders it needs.

    Small clusters are one file, large ones are split by size. Rows without a cluster are in a folder of their own.
    """
    assigned.hint("rebalance", F.col("cluster_id")).write.partitionBy("cluster_id").parquet(path)
    return assigned.sparkSession.read.schema(assigned.schema).parquet(path)


def nearest_in_clusters(stored: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 5, probes: int = 2, metric: str = "cosine") -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best of the vectors in the ``probes`` clusters nearest to each query, ties by id.

    ``stored(id, vector, cluster_id)`` comes from ``store``; only folders of clusters that some query
    goes to are read, and a vector meets the queries of its cluster only, in place: the queries go to
    the tasks, in parts of QUERY_BYTES. No row is a query and a member. Null vectors take no part, ids of
    queries are their own. More probes give more of the exact neighbours; as many as there are clusters give all.
    """
    asked = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector")
    near = nearest_clusters(asked, centroids, probes).select("query_id", F.col("cluster_id").cast("long").alias("cluster_id"))
    routes = write_table(near.join(asked, "query_id"), "routes")
    size = routes.agg(F.sum(F.size("vector").cast("long") * 8 + 24)).first()[0] or 0
    parts = max(1, -(-size // vector.QUERY_BYTES))
    share = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    found = [_in_clusters(stored, routes.filter(share == i) if parts > 1 else routes, k, metric) for i in range(parts)]
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _in_clusters(stored: DataFrame, routes: DataFrame, k: int, metric: str) -> DataFrame:
    own = routes.toArrow()  # about QUERY_BYTES
    names, clusters = own.column("query_id").to_numpy(), own.column("cluster_id").to_numpy()
    flat = own.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(names), -1) if len(names) else np.zeros((0, 1))
    numbers = np.unique(names, return_inverse=True)
    by_cluster = {int(c): np.flatnonzero(clusters == c) for c in np.unique(clusters)}
    model = stored.sparkSession.sparkContext.broadcast((*numbers, matrix, by_cluster))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, matrix, by_cluster = model.value
        held = []
        for batch in batches:
            own = batch.column("cluster_id").to_numpy()
            for c in np.unique(own):
                some = batch.filter(pa.array(own == c))
                for at in range(0, some.num_rows, 2048):
                    part = some.slice(at, 2048)
                    for q in range(0, len(by_cluster[c]), vector.QUERY_BLOCK):
                        rows = by_cluster[c][q : q + vector.QUERY_BLOCK]
                        query, ids, scores = vector.compared(matrix[rows], part.column("vector"), part.column("id").to_numpy(zero_copy_only=False), k, metric)
                        held.append((number[rows][query], ids, scores))
                    held = [vector.best_of(held, k)]
        if held:
            query, ids, scores = held[0]
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(ids), pa.array(scores)], names=["query_id", "id", "score"])

    met = stored.filter(F.col("cluster_id").isin([*by_cluster]) & F.col("vector").isNotNull())  # as many as centroids at most: the folders that are read
    return bounded(met.select("id", "vector", F.col("cluster_id").cast("long").alias("cluster_id"))).mapInArrow(search, "query_id bigint, id bigint, score double")


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """Per cluster its size and the sum of squared distances."""
    return assigned.groupBy("cluster_id").agg(
        F.count("*").alias("size"), F.round(F.sum(F.col("cluster_distance") * F.col("cluster_distance")), 4).alias("inertia")
    )


def fit(vectors: DataFrame, k: int, restarts: int = 10, seed: int = 42, iterations: int = 300) -> DataFrame:
    """``cluster_id, centroid`` of the best of some K-means runs, which go side by side, see ``kmeans``.

    k is n - 1 at most, fewer than two rows give none. Vectors that can't be compared take no part.
    """
    spark, table = vectors.sparkSession, kmeans.distinct_vectors(vectors)
    n = table.agg(F.sum("w")).first()[0] or 0
    if n < 2:
        return spark.createDataFrame([], "cluster_id int, centroid array<double>")
    best = min(kmeans.fit_runs(table, [(min(k, n - 1), seed + i) for i in range(restarts)], iterations), key=lambda r: r.cost)
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(best.centroids)], "cluster_id int, centroid array<double>")


def optimal_clusters(vectors: DataFrame, low: int = 3, high: int = 10, seed: int = 42, restarts: int = 10) -> int:
    """Few rows: min(3, n - 1), or 5; else the k whose best run has the best silhouette, the first of equals.

    All k and all restarts go side by side.
    """
    table = kmeans.distinct_vectors(vectors)
    n = table.agg(F.sum("w")).first()[0] or 0
    if n < 20:
        return max(1, min(3, n - 1))
    if n < 50:
        return 5
    runs = kmeans.fit_runs(table, [(k, seed + i) for k in range(low, high + 1) for i in range(restarts)])
    best = [min((r for r in runs if r.k == k), key=lambda r: r.cost) for k in range(low, high + 1)]
    return -max((s, -r.k) for s, r in zip(kmeans.silhouettes(table, best), best, strict=True))[1]
