"""The indexing job: documents to annotated, deduplicated, embedded and clustered chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import annotate, chunk
from tessera.functions.text import bound, content_hash
from tessera.operators import cluster, dedup, embed
from tessera.schema import INDEX


def chunk_documents(documents: DataFrame, timestamp: str = "2024-01-31 00:00:00", window: tuple[int, int] | None = None) -> DataFrame:
    """Index rows of ``documents(source, text, file_hash, file_modified)``, exact copies of a chunk left out.

    Types come from names and texts, window sizes (unless ``window``, a size and an overlap, is given) from types and languages. Ids are hashes of
    source and place, so a rerun gives the same.
    """
    typed, pieces = _cut(documents, window)
    cut = typed.withColumn("pieces", pieces).withColumn("doc_keywords", annotate.keywords(F.substring("text", 1, 3000)))
    rows = cut.select(
        "source", "doc_type", "language", "file_hash", "file_modified", "doc_keywords", F.size("pieces").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "chunk")
    )
    return _index_rows(dedup.first_by_content(rows, "chunk", ["source", "chunk_index"]), timestamp)


def _cut(documents: DataFrame, window: tuple[int, int] | None) -> tuple[DataFrame, Column]:
    """The documents with a text, with their types and languages, and the column of the pieces of a text."""
    typed = (
        documents.filter(F.col("text").isNotNull())
        .withColumn("doc_type", annotate.document_type(F.col("text"), F.col("source"))).withColumn("language", annotate.document_language(F.col("text")))
    )
    size, overlap = window or chunk.chunk_params(F.col("doc_type"), F.col("language"))
    return typed, chunk.windows(F.col("text"), size, overlap)


def _index_rows(rows: DataFrame, timestamp: str) -> DataFrame:
    """Rows of the index of chunks; columns that aren't there yet have their defaults."""
    made = {
        "id": F.xxhash64("source", "chunk_index"),
        "timestamp": F.lit(timestamp).cast("timestamp"),
        "page_number": F.coalesce(F.regexp_extract("chunk", r"\[Page (\d+)\]", 1).try_cast("int"), F.lit(0)),
        "section_header": F.regexp_extract("chunk", r"(?m)^#{1,6} (.+)$", 1),
        "vector": F.lit(None),
        "cluster_id": F.lit(0),
        "cluster_distance": F.lit(0.0),
    }
    column = lambda name: F.col(name) if name in rows.columns else made[name]
    return rows.select(*(column(f.name).cast(f.dataType).alias(f.name) for f in INDEX))


def chunk_hashes(documents: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """``source, chunk_index, chunk_hash`` of the rows of ``chunk_documents``: no text leaves its task."""
    typed, pieces = _cut(documents, window)
    hashes = typed.select("source", F.posexplode(F.transform(pieces, content_hash)).alias("chunk_index", "chunk_hash"))
    first = hashes.groupBy("chunk_hash").agg(F.min(F.struct("source", "chunk_index")).alias("place"))
    return first.select("place.source", "place.chunk_index", "chunk_hash")


def chunk_texts(documents: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """``id, text`` of all chunks, copies too."""
    typed, pieces = _cut(documents, window)
    return typed.select("source", F.posexplode(pieces).alias("chunk_index", "text")).select(F.xxhash64("source", "chunk_index").alias("id"), "text")


def chosen_chunks(documents: DataFrame, timestamp: str = "2024-01-31 00:00:00", window: tuple[int, int] | None = None, dim: int = 64) -> DataFrame:
    """Index rows of the chunks that ``chosen``, an array of structs with a ``chunk_index``, names of each of the documents.

    Other fields of the structs are columns of the index; without a vector among them the chunks are embedded in place.
    """
    typed, pieces = _cut(documents, window)
    named = lambda p: F.transform("chosen", lambda k: F.struct(k.alias("k"), F.get(p, k["chunk_index"]).alias("chunk"), F.size(p).alias("total_chunks")))
    # made before the rows are: beside an explode they would be made of the text for each chunk
    whole = typed.withColumn("doc_keywords", annotate.keywords(F.substring("text", 1, 3000))).withColumn("c", bound(pieces, named))
    cut = whole.select("source", "doc_type", "language", "file_hash", "file_modified", "doc_keywords", F.explode("c").alias("c"))
    rows = cut.select(*(c for c in cut.columns if c != "c"), "c.k.*", "c.chunk", "c.total_chunks").withColumn("chunk_hash", content_hash(F.col("chunk")))
    return _index_rows(rows if "vector" in rows.columns else embed.with_embedding(rows, dim, "chunk"), timestamp)


def build_index(documents: DataFrame, dim: int = 64, threshold: float = 0.95, clusters: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The index of ``documents``, and its centroids.

    Chunks are embedded by the hashing default; near copies go, in order of id; with more
    than two chunks left they are clustered.
    """
    rows = dedup.write_table(chunk_documents(documents), "chunks")
    vectors = dedup.write_table(embed.hashed_embedding(rows.select("id", F.col("chunk").alias("text")), dim), "vectors")
    kept = dedup.write_table(dedup.first_by_similarity(vectors, threshold), "kept")
    n = kept.count()
    if n > 2:
        centroids = cluster.fit(kept, clusters or cluster.optimal_clusters(kept))
        placed = cluster.assign(kept, centroids)
    else:
        centroids = kept.sparkSession.createDataFrame([], "cluster_id int, centroid array<double>")
        placed = kept.withColumn("cluster_id", F.lit(0)).withColumn("cluster_distance", F.lit(0.0))
    full = rows.drop("vector", "cluster_id", "cluster_distance").join(placed, "id")
    return full.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in INDEX)), centroids


def manifest(documents: DataFrame, *kept: str) -> DataFrame:
    """``documents(doc_id, text)`` as files: a source name, hash and time of each, and the ``kept`` columns."""
    return documents.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), content_hash(F.col("text")).alias("file_hash"),
        F.lit("2024-01-01").cast("timestamp").alias("file_modified"), *kept,
    )
