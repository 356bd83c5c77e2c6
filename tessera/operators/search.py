"""Search: hybrid retrieval, filters, boosts, fallback and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.annotate import should_expand
from tessera.operators import bm25, boosts, fuse
from tessera.operators.vector import dot, nearest
from tessera.session import write_table


def keyword_boost(keywords: Column, source: Column, doc_keywords: Column, chunk: Column) -> Column:
    """Per keyword 1.5 in the source, 1.0 in the document's keywords, 0.5 in the chunk's first 500 characters."""
    head = F.substring(F.lower(chunk), 1, 500)

    def one(word: Column) -> Column:
        low = F.lower(word)
        hit = lambda text, points: F.when(F.contains(text, low), points).otherwise(0.0)
        return hit(F.lower(F.coalesce(source, F.lit(""))), 1.5) + hit(F.lower(F.coalesce(doc_keywords, F.lit(""))), 1.0) + hit(F.coalesce(head, F.lit("")), 0.5)

    return F.aggregate(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), one), F.lit(0.0), lambda total, x: total + x)


def type_boost(hint: Column, source: Column, doc_type: Column, chunk: Column) -> Column:
    """By document type hint: for meetings 5, 3 or 1 by where the word is; else 2 for the type itself."""
    name, head = F.lower(F.coalesce(source, F.lit(""))), F.substring(F.lower(F.coalesce(chunk, F.lit(""))), 1, 200)
    meeting = F.when(name.contains("meeting"), 5.0).when(doc_type == "meeting", 3.0).when(head.contains("meeting"), 1.0).otherwise(0.0)
    return F.when(hint.isNull(), 0.0).when(hint == "meeting", meeting).when(doc_type == hint, 2.0).otherwise(0.0)


def boosted_cosine(candidates: DataFrame, k: int = 5, share: float = 0.3) -> DataFrame:
    """The ``k`` best of each query by cosine plus ``share`` of the boost over the largest boost (1 at least).

    ``candidates(query_id, id, query_vector, vector, boost)``; adds ``distance, score, rank``.
    A tie goes to the newer ``file_modified`` if there is such a column, then to the id.
    """
    length = lambda v: F.sqrt(dot(v, v))
    similarity = dot(F.col("query_vector"), F.col("vector")) / (length(F.col("query_vector")) * length(F.col("vector")))
    most = F.greatest(F.max("boost").over(Window.partitionBy("query_id")), F.lit(1.0))
    scored = candidates.withColumn("_s", similarity).withColumn("score", F.round(F.col("_s") + share * F.col("boost") / most, 6))
    ties = [F.col("file_modified").desc_nulls_last()] if "file_modified" in candidates.columns else []
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ties, "id")
    ranked = scored.withColumn("distance", F.round(1 - F.col("_s"), 6)).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).drop("_s")


def boosted_nearest(docs: DataFrame, queries: DataFrame, k: int = 5, share: float = 0.3) -> DataFrame:
    """``query_id, id, distance, score, rank``: as ``boosted_cosine``, of every query against all of ``docs``.

    ``docs(id, text, source, doc_type, doc_keywords, vector)`` stay in place, see ``boosts.best_boosted``. A
    tie goes to the newer ``file_modified``, if there is such a column, then to the id. Null
    vectors of docs and of ``queries(query_id, vector, keywords, hint)`` take no part.
    """
    routes = queries.select(F.lit(0).alias("cluster_id"), "query_id", "vector", "keywords", F.col("hint").alias("doc_type_hint"), F.lit(True).alias("recent"))
    return boosts.best_boosted(docs.withColumn("cluster_id", F.lit(0)), routes, k, share)


def most_boosted(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, id, boost, rank``: the ``k`` documents of the highest boost for each query, ties to the smaller id; all documents count."""
    routes = queries.select(F.lit(0).alias("cluster_id"), "query_id", "keywords", F.col("hint").alias("doc_type_hint"), F.lit(False).alias("recent"))
    found = boosts.best_boosted(docs.withColumn("cluster_id", F.lit(0)), routes, k, None)
    return found.select("query_id", "id", F.col("score").alias("boost"), "rank")


def pair_boosts(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, id, by_word, by_type``: both boosts of every document of ``docs(id, text, source, doc_type, doc_keywords)`` for every query.

    A document meets each distinct pair of keywords and hint of ``queries(query_id, keywords, hint)``
    once, by its head alone; what comes of that goes to the queries that ask so.
    """
    asked = write_table(queries.select("query_id", F.col("keywords").alias("_words"), F.col("hint").alias("_hint")), "asked")
    profiles = write_table(asked.select(F.col("_words").alias("keywords"), F.col("_hint").alias("hint")).distinct(), "profiles")
    heads = docs.select("id", "source", "doc_type", "doc_keywords", F.substring(F.lower("text"), 1, 500).alias("head"))
    by_word = keyword_boost(F.col("keywords"), F.col("source"), F.col("doc_keywords"), F.col("head"))
    by_type = type_boost(F.col("hint"), F.col("source"), F.col("doc_type"), F.col("head"))
    boosts = heads.crossJoin(profiles).select("id", "keywords", "hint", by_word.alias("by_word"), by_type.alias("by_type"))
    same = F.col("keywords").eqNullSafe(F.col("_words")) & F.col("hint").eqNullSafe(F.col("_hint"))
    return boosts.join(asked, same).select("query_id", "id", "by_word", "by_type")


def within(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """``rows`` restricted to ``ids(id)``, before any ranking; all rows without ids."""
    return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")


def hybrid_search(
    chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, alpha: float = 0.5, mode: str = "hybrid", ids: DataFrame | None = None, metric: str = "cosine"
) -> DataFrame:
    """``query_id, id, score, rank`` of ``chunks(id, text)`` and ``vectors(id, vector)``.

    ``queries(query_id, query, vector)`` all run at once. Both lists hold 2 k hits (3 k with
    an id filter); filters apply before the lists are cut.
    """
    chunks, vectors = within(chunks, ids), within(vectors, ids)
    fetched = k * (3 if ids is not None else 2)
    if mode == "keyword":
        return bm25.search(chunks, queries, k)
    if mode == "vector":
        return nearest(vectors, queries, k, metric)
    if mode != "hybrid":
        raise ValueError(mode)
    fused = fuse.reciprocal_ranks(bm25.search(chunks, queries, fetched), nearest(vectors, queries, fetched, metric), alpha)
    return fused.filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def quality(vector_hits: DataFrame) -> DataFrame:
    """``query_id, quality``: one less the mean cosine distance of a query's vector hits."""
    return vector_hits.groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("quality"))


def with_fallback(focused: DataFrame, broad: DataFrame, vector_hits: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Focused results; broad ones for queries with none, or of too little quality.

    The broad results are restricted to those queries by an anti-join.
    """
    good = quality(vector_hits).filter(~should_expand(F.col("quality"), threshold)).select("query_id")
    found = focused.join(good, "query_id", "left_semi")
    served = found.select("query_id").distinct()
    return found.withColumn("stage", F.lit("focused")).unionByName(broad.join(served, "query_id", "left_anti").withColumn("stage", F.lit("broad")))


def two_stage(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, ids: DataFrame, k: int = 5, threshold: float = 0.3) -> DataFrame:
    """Keyword search among ``ids(id)``, filtered before it ranks; queries it doesn't serve get the search of all chunks."""
    focused = bm25.search(within(chunks, ids), queries, k)
    return with_fallback(focused, bm25.search(chunks, queries, k), nearest(vectors, queries, k), threshold)


def by_ids(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The chunks of ``hits(query_id, id, rank)``, in rank order within each query; unknown ids drop out."""
    return hits.join(chunks, "id").orderBy("query_id", "rank")


def context(hits: DataFrame) -> DataFrame:
    """``query_id, bullets, citations`` for ``hits(query_id, rank, source, text)``.

    Bullets are the first 500 characters of each hit; citations count the sections of each
    source, numbered by their first hit.
    """
    listed = hits.withColumn("bullet", F.concat(F.lit("• "), F.substring("text", 1, 500)))
    bullets = listed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "bullet"))).alias("b"))
    sources = hits.groupBy("query_id", "source").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    wording = F.when(F.col("n") == 1, F.lit(" (1 relevant section)")).otherwise(F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" relevant sections)")))
    line = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] **"), F.col("source"), F.lit("**"), wording)
    cited = sources.withColumn("number", number).withColumn("line", line)
    citations = cited.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("number", "line"))).alias("c"))
    return bullets.join(citations, "query_id").select(
        "query_id",
        F.array_join(F.transform("b", lambda x: x["bullet"]), "\n").alias("bullets"),
        F.array_join(F.transform("c", lambda x: x["line"]), "\n").alias("citations"),
    )
