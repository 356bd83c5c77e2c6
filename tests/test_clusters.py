"""K-means of all runs at once, and vectors stored by cluster."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import cluster, kmeans

SCHEMA = "id bigint, vector array<double>"


def blobs(rows, sizes, spread=0.3, seed=3):
    draw = np.random.default_rng(seed)
    out = []
    for i, n in enumerate(sizes):
        middle = 10 * np.array([np.cos(i), np.sin(i), i % 3])
        out += [(len(out) + j, [float(x) for x in middle + spread * draw.normal(size=3)]) for j in range(n)]
    return rows(out, SCHEMA), np.array([v for _, v in out])


def test_runs_are_fixed_points_with_their_costs(rows):
    vectors, x = blobs(rows, [40, 30, 20, 10, 25], 2.0)
    table = kmeans.distinct_vectors(vectors.repartition(3))
    for run in kmeans.fit_runs(table, [(4, 1), (4, 2), (6, 3)]):
        d = ((x[:, None] - run.centroids[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert len(run.centroids) == run.k
        assert run.cost == pytest.approx(d.min(axis=1).sum())
        for j in range(run.k):
            assert np.allclose(run.centroids[j], x[own == j].mean(axis=0), atol=1e-3)


def test_not_worse_than_separate_fits(rows):
    vectors, x = blobs(rows, [60, 50, 40, 30, 20, 10], 1.0)
    featured = vectors.select(array_to_vector("vector").alias("features")).cache()
    separate = min(KMeans(k=6, seed=42 + i, maxIter=300).fit(featured).summary.trainingCost for i in range(3))
    centroids = np.array([r.centroid for r in cluster.fit(vectors, 6).collect()])
    assert ((x[:, None] - centroids[None]) ** 2).sum(axis=2).min(axis=1).sum() <= separate * (1 + 1e-6)


def test_silhouettes_and_the_best_k(rows):
    vectors, x = blobs(rows, [30, 30, 30, 30])
    table = kmeans.distinct_vectors(vectors)
    run = min(kmeans.fit_runs(table, [(4, s) for s in range(3)]), key=lambda r: r.cost)
    two = kmeans.Run(2, 0, run.centroids[:2])
    placed = [rows([(int(np.argmin(((v - r.centroids) ** 2).sum(axis=1))), v.tolist()) for v in x], "prediction int, vector array<double>") for r in (run, two)]
    want = [ClusteringEvaluator().evaluate(p.select("prediction", array_to_vector("vector").alias("features"))) for p in placed]
    assert kmeans.silhouettes(table, [run, two]) == pytest.approx(want, abs=1e-6)
    assert cluster.optimal_clusters(vectors, restarts=3) == 4


def test_copies_weigh_and_odd_vectors_take_no_part(rows):
    one, other = [0.0, 0.0], [4.0, 0.0]
    data = [(i, one) for i in range(30)] + [(i, other) for i in range(30, 40)] + [(50, [1.0, 0.0])]
    odd = [(60, None), (61, [None, 1.0]), (62, [float("nan"), 1.0]), (63, [float("inf"), 1.0])]
    vectors = rows(data + odd, SCHEMA)
    table = kmeans.distinct_vectors(vectors)
    assert sorted(r.w for r in table.collect()) == [1, 10, 30]
    found = sorted(r.centroid for r in cluster.fit(vectors, 2).collect())
    assert np.allclose(found, [[1 / 31, 0], [4, 0]])
    assert cluster.fit(vectors, 5).count() == 3
    assert cluster.fit(rows([(1, one), (2, one)], SCHEMA), 1).first().centroid == one
    assert cluster.fit(rows(odd, SCHEMA), 3).count() == 0


def test_partitions_dont_matter(rows):
    vectors, _ = blobs(rows, [40, 30, 20], 3.0)
    found = [np.array([r.centroid for r in cluster.fit(vectors.repartition(n), 4, restarts=3).orderBy("cluster_id").collect()]) for n in (1, 5)]
    assert np.allclose(*found)


def made(rows, tmp_path):
    draw = np.random.default_rng(5)
    data = [(i, [float(x) for x in draw.normal(size=4)]) for i in range(300)]
    vectors = rows(data, SCHEMA)
    centroids = rows([(i, [float(x) for x in draw.normal(size=4)]) for i in range(6)], "cluster_id int, centroid array<double>")
    stored = cluster.store(cluster.assign(vectors, centroids).unionByName(rows([(900, None, None, None)], SCHEMA + ", cluster_id int, cluster_distance double")), str(tmp_path / "v"))
    queries = rows([(i, v) for i, v in data[:9]] + [(77, None)], "query_id bigint, vector array<double>")
    return data, vectors, centroids, stored, queries


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_neighbours_in_clusters(rows, tmp_path, monkeypatch, metric):
    from tessera.operators import vector

    data, vectors, centroids, stored, queries = made(rows, tmp_path)
    order = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    own = {r.id: r.cluster_id for r in cluster.assign(vectors, centroids).collect()}
    near = {}
    for r in cluster.nearest_clusters(queries.filter("vector is not null"), centroids, 2).collect():
        near.setdefault(r.query_id, set()).add(r.cluster_id)
    every = order(vector.nearest(vectors, queries, 300, metric))
    want = {q: [(i, s) for x, _, i, s in every if x == q and own[i] in near[q]][:5] for q in near}
    got = order(cluster.nearest_in_clusters(stored, queries, centroids, 5, 2, metric))
    assert {q: [(i, s) for x, _, i, s in got if x == q] for q in near} == want
    assert order(cluster.nearest_in_clusters(stored, queries, centroids, 5, 6, metric)) == order(vector.nearest(vectors, queries, 5, metric))
    monkeypatch.setattr(vector, "QUERY_BYTES", 200)
    assert order(cluster.nearest_in_clusters(stored, queries, centroids, 5, 2, metric)) == got
    assert cluster.nearest_in_clusters(stored, queries.filter("query_id = 77"), centroids).count() == 0


def test_only_folders_of_wanted_clusters_are_read(rows, tmp_path):
    _, _, centroids, stored, queries = made(rows, tmp_path)
    found = cluster.nearest_in_clusters(stored, queries.limit(1), centroids, 5, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan or "PartitionFilters: [(cluster_id" in plan or "PartitionFilters: [cluster_id" in plan
    wanted = cluster.nearest_clusters(queries.limit(1), centroids, 1).first().cluster_id
    files = {r[0] for r in stored.filter(F.col("cluster_id").isin([wanted])).select(F.input_file_name()).distinct().collect()}
    assert files and all(f"cluster_id={wanted}/" in f for f in files)
