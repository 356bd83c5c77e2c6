"""Fusing ranked lists, and combining scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to each rank.
RANK_CONSTANT = 60


def reciprocal_ranks(keyword: DataFrame, vector: DataFrame, alpha: float = 0.5, constant: int = RANK_CONSTANT) -> DataFrame:
    """``query_id, id, score, keyword_rank, vector_rank, rank`` of two lists ``(query_id, id, rank)``.

    A list adds its weight (1 - alpha for keywords, alpha for vectors) over ``constant`` plus
    the rank; a list without the id adds nothing. Ties: keyword hits first by their rank,
    then vector hits by theirs.
    """
    one = keyword.select("query_id", "id", F.col("rank").alias("keyword_rank"))
    two = vector.select("query_id", "id", F.col("rank").alias("vector_rank"))
    share = lambda weight, rank: F.coalesce(F.lit(weight) / (F.lit(float(constant)) + F.col(rank)), F.lit(0.0))
    score = F.round(share(1 - alpha, "keyword_rank") + share(alpha, "vector_rank"), 9)
    fused = one.join(two, ["query_id", "id"], "full_outer").withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("keyword_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), "id")
    return fused.withColumn("rank", F.row_number().over(order))


def min_max(score: Column, group: str) -> Column:
    """Scores of a group brought to 0..1; 0.5 if they are all equal."""
    own = Window.partitionBy(group)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return F.when(high == low, F.lit(0.5)).otherwise((score - low) / (high - low))
