"""One search for a batch of queries: analysis, clusters, boosts, quality, fallback and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.annotate import analyze_query, should_expand
from tessera.operators import boosts, cluster, rerank, search
from tessera.session import write_table

def focused_search(chunks: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = 5, share: float = 0.3) -> DataFrame:
    """``query_id, id, distance, score, rank``: boosted cosine of each query in its two nearest clusters.

    ``chunks(id, text, source, doc_type, doc_keywords, vector, cluster_id)`` stay where they are, see
    ``boosts.best_boosted``. A tie goes to the newer ``file_modified``, if the query asks for
    recent ones and there is such a column, then to the id. Without centroids there is one
    cluster. Null vectors take no part; ``queries(query_id, vector, keywords, doc_type_hint,
    temporal_hint)`` have ids of their own.
    """
    asked = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector", "keywords", "doc_type_hint", (F.col("temporal_hint") == "recent").alias("recent"))
    if centroids.isEmpty():
        chunks, near = chunks.withColumn("cluster_id", F.lit(0)), asked.select("query_id", F.lit(0).alias("cluster_id"))
    else:
        near = cluster.nearest_clusters(asked, centroids, 2).select("query_id", "cluster_id")
    return boosts.best_boosted(chunks, near.join(asked, "query_id"), k, share)


def smart_search(
    chunks: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.3, scorer: Callable[[Column, Column], Column] = rerank.coverage
) -> DataFrame:
    """``query_id, id, stage, rerank_score, rank``: the ``k`` best of ``queries(query_id, query, vector)``.

    Each query is analysed. One with keywords or a hint gets the focused search; where that
    finds nothing, or its mean similarity is below ``threshold``, and for all others, hybrid
    search over all chunks gives three times k. What is found is ranked again by ``scorer``;
    ties keep the order they had.
    """
    analysed = queries.select("query_id", "query", "vector", analyze_query(F.col("query")).alias("_a"))
    asked = write_table(analysed.select("query_id", "query", "vector", "_a.*"), "analysed")
    guided = asked.filter(F.col("doc_type_hint").isNotNull() | F.col("temporal_hint").isNotNull() | (F.size("keywords") > 0))
    focused = write_table(focused_search(chunks, centroids, guided, k), "focused")
    likeness = search.quality(focused.select("query_id", (1 - F.col("distance")).alias("score")))
    good = likeness.filter(~should_expand(F.col("quality"), threshold)).select("query_id")
    rest = write_table(asked.join(good, "query_id", "left_anti").select("query_id", "query", "vector"), "broadened")
    broad = search.hybrid_search(chunks.select("id", "text"), chunks.select("id", "vector"), rest, 3 * k)
    served = focused.join(good, "query_id", "left_semi").select("query_id", "id", F.col("rank").alias("_before"), F.lit("focused").alias("stage"))
    found = write_table(served.unionByName(broad.select("query_id", "id", F.col("rank").alias("_before"), F.lit("broad").alias("stage"))), "found")
    told = found.join(asked.select("query_id", "query"), "query_id").join(chunks.select("id", "text"), "id")
    scored = told.withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "_before", "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "stage", "rerank_score", "rank")
