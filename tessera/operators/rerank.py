"""Reranking of candidates by a scorer, alone or with the first score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bound, terms
from tessera.operators.fuse import min_max
from tessera.operators.order import numbered
from tessera.session import write_table

# Presets of scorers by name; an unknown name stands for itself.
PRESETS = {
    "fast": "cross-encoder/ms-marco-MiniLM-L-6-v2",
    "balanced": "cross-encoder/ms-marco-MiniLM-L-12-v2",
    "accurate": "BAAI/bge-reranker-base",
    "multilingual": "cross-encoder/mmarco-mMiniLMv2-L12-H384-v1",
}


def model_name(preset: str | None) -> str:
    return PRESETS.get(preset or "balanced", preset)


def coverage(query: Column, text: Column) -> Column:
    """Deterministic scorer: the share of the query's distinct terms that the text has."""
    asked = F.array_distinct(terms(query))
    return bound(asked, lambda a: F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, terms(text))) / F.size(a)))


def rerank(candidates: DataFrame, top_k: int, scorer: Callable[[Column, Column], Column] = coverage) -> DataFrame:
    """The ``top_k`` of each query of ``candidates(query_id, id, query, text)`` with ``rerank_score, rank``."""
    scored = candidates.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def combined(candidates: DataFrame, weight: float = 0.7, scorer: Callable[[Column, Column], Column] = coverage) -> DataFrame:
    """``final_score``: scorer and first score, each brought to 0..1 in its query, weighted.

    ``candidates`` have ``query_id, id, query, text, score``; a missing first score is 0.
    """
    scored = candidates.withColumn("rerank_score", scorer(F.col("query"), F.col("text"))).withColumn("score", F.coalesce("score", F.lit(0.0)))
    final = weight * min_max(F.col("rerank_score"), "query_id") + (1 - weight) * min_max(F.col("score"), "query_id")
    scored = scored.withColumn("final_score", F.round(final, 6))
    order = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order))


def latency_summary(times: DataFrame, value: str, group: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Mean, deviation, extremes and percentiles (exact, interpolated) of measured times per group.

    All rows are put in order of group and value over the whole cluster; a group's percentiles
    are the rows at their places, so no group is gathered in one task.
    """
    shares = shares or {"p50": 0.5, "p95": 0.95}
    placed = write_table(numbered(times.select(F.col(group), F.col(value).alias("_v")).filter("_v is not null"), group, "_v", name="_place"), "latencies")
    v = F.col("_v")
    sums = placed.groupBy(group).agg(
        F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.min("_place").alias("_start"), F.count("*").alias("_n"),
    )
    sums = write_table(sums, "latency-sums")
    at = {name: F.lit(share) * (F.col("_n") - 1) for name, share in shares.items()}
    places = F.array_distinct(F.array(*(f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil))))
    wanted = sums.select(F.col(group).alias("_g"), "_start", F.explode(places).alias("_at")).withColumn("_place", F.col("_start") + F.col("_at"))
    found = placed.join(wanted, "_place").groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_values"))  # two rows a share
    value_at = lambda x: F.try_element_at("_values", x.cast("long"))
    cells = [
        F.round(value_at(F.floor(x)) + (x - F.floor(x)) * (value_at(F.ceil(x)) - value_at(F.floor(x))), 6).alias(name) for name, x in at.items()
    ]
    return sums.join(found, F.col(group).eqNullSafe(F.col("_g"))).select(group, "mean", "std", "min", "max", *cells)
