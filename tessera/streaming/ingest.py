"""Incremental indexing of a stream of documents."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.jobs.index import chosen_chunks, chunk_hashes, chunk_texts
from tessera.operators import cluster, dedup, embed, nearness
from tessera.schema import INDEX, LEDGER
from tessera.session import write_table
from tessera.sources import tables


#: Bytes of texts that a task gathers for a bucket, about.
GATHERED_BYTES = 32 * 1024 * 1024


def numbered_rows(batch: DataFrame) -> DataFrame:
    """The rows of ``batch(source, text, file_hash, file_modified)``, each with a ``row`` number, as a table.

    Rows without a hash (unreadable files) are left out, as are those without a source.
    """
    seen = batch.filter(F.col("source").isNotNull() & F.col("file_hash").isNotNull()).select("source", "text", "file_hash", "file_modified")
    return write_table(seen.withColumn("row", F.monotonically_increasing_id()), "batch", compression="zstd")


def last_of_each(rows: DataFrame) -> DataFrame:
    """``source, file_hash, file_modified, row``, one for each source: the newest, then the one of the largest hash. Texts stay where they are."""
    newest = F.struct(F.col("file_modified").isNotNull(), "file_modified", "file_hash", F.xxhash64("text"), "row")
    return rows.groupBy("source").agg(F.max(newest).alias("r")).select("source", "r.file_hash", "r.file_modified", "r.row")


def rows_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose number is in ``asked(row)``.

    The numbers are bitmaps, a bit a row, so they go to the tasks of the texts, and no text goes through a shuffle.
    """
    number, place = F.bitmap_bucket_number("row"), F.bitmap_bit_position("row")
    bits = write_table(asked.groupBy(number.alias("_number")).agg(F.bitmap_construct_agg(place).alias("_bits")), "row-bits", compression="zstd")
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.expr("_byte >> CAST(bitmap_bit_position(row) % 8 AS INT) & 1") == 1
    return rows.join(bits, number == F.col("_number")).withColumn("_byte", byte).filter(there).select(*rows.columns)


def gathered(texts: DataFrame, chosen: DataFrame, before: tables.Snapshot, size: int) -> DataFrame:
    """``texts`` with the ``chosen(source, chosen)`` of their sources, a bucket's together: the only shuffle that texts go through.

    Buckets are parted so that a part has about GATHERED_BYTES of the ``size`` bytes of texts.
    """
    parts = max(1, -(-size // (before.buckets * GATHERED_BYTES)))
    keys = [before.bucket().alias("bucket"), F.pmod(F.xxhash64("source", F.lit(1)), F.lit(parts)).alias("part"), "source"]
    document = F.struct("text", "file_hash", "file_modified").alias("document")
    ours = texts.filter(F.col("text").isNotNull()).select(*keys, document)
    both = ours.unionByName(chosen.select(*keys, "chosen"), allowMissingColumns=True).repartition("bucket", "part")
    met = both.groupBy("bucket", "part", "source").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("document", "chosen")))
    return met.filter(F.col("document").isNotNull() & F.col("chosen").isNotNull()).select("source", "document.*", "chosen")


def index_batch(
    spark: SparkSession, batch: DataFrame, path: str, number: int | None = None, stream: str = "batches", threshold: float | None = 0.95, dim: int = 64,
    centroids: DataFrame | None = None, window: tuple[int, int] | None = None,
) -> tables.Snapshot:
    """Index what is new or changed of a batch ``(source, text, file_hash, file_modified)``, in one change of the index.

    The ledger of sources says what is new: a source whose chunks were all copies is in it too. Changed
    sources lose their old chunks. Of the new chunks those go whose text another chunk of the batch
    or of the index has, or whose vector is ``threshold`` like an earlier one's (none: all stay):
    first come the vectors of the index, then the batch's in order of id. Vectors are placed in
    the nearest of ``centroids``, if given. ``window`` as in ``chunk_documents``.

    A batch with a ``number`` that the index already has of its ``stream``, or an earlier one,
    changes nothing; one without a number finds nothing new the second time. So every batch can
    be repeated, and one that breaks off leaves the index as it was. What it counts on the way is kept
    with the state that it makes (``tables.runs``). A chunk that was left out as a copy
    comes back, should its like go, when its source is next indexed.

    What stays is decided by hashes and places alone. The texts are written once, as they come, go to
    their buckets once, and are cut into chunks there.
    """
    before = tables.create(spark, path)
    if number is not None and before.batches.get(stream, -1) >= number:
        return before
    mark = None if number is None else (stream, number)
    ledger = before.table(spark, "sources")
    began, seen, cut, stayed = time.monotonic(), Observation(), Observation(), Observation()
    count = F.count(F.lit(1))
    counted = batch.observe(seen, count.alias("files"), F.count_if(F.col("file_hash").isNull()).alias("unreadable"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"))
    rows = numbered_rows(counted)
    status = dedup.change_status(last_of_each(rows), ledger, "file_hash", "file_modified", "row")
    todo = write_table(status.filter("status in ('new', 'changed')"), "to-index", compression="zstd")
    if todo.isEmpty():
        return before if mark is None else tables.change(spark, before, batch=mark)
    changed = write_table(todo.filter("status = 'changed'").select("source"), "changed", compression="zstd")
    touched = {r[0] for r in changed.select(before.bucket().alias("b")).distinct().collect()}  # a number a bucket

    texts = rows_of(rows, todo)
    hashes = write_table(chunk_hashes(texts, window).observe(cut, count.alias("chunks")), "new-chunks", compression="zstd")
    unlike = hashes.select("source", "chunk_index")
    if before.folders["chunks"]:
        there = before.table(spark, "chunks").select("source", "chunk_hash").join(hashes.select("chunk_hash"), "chunk_hash", "left_semi")
        copies = there.join(changed, "source", "left_anti").select("chunk_hash").distinct()
        unlike = write_table(hashes.join(copies, "chunk_hash", "left_anti").select("source", "chunk_index"), "unlike-chunks", compression="zstd")
    if threshold is not None or centroids is not None:
        named = unlike.select(F.xxhash64("source", "chunk_index").alias("id"), "source", "chunk_index")
        embedded = embed.hashed_embedding(chunk_texts(texts, window), dim).withColumn("vector", F.col("vector").cast("array<float>"))
        vectors = write_table(embedded.join(named, "id", "left_semi"), "new-vectors")
        if threshold is not None:
            vectors = dedup.first_by_similarity(vectors, threshold, _anchors(spark, before, changed, touched))
        placed = vectors.withColumn("cluster_id", F.lit(0)).withColumn("cluster_distance", F.lit(0.0)) if centroids is None else cluster.assign(vectors, centroids)
        typed = (F.col(f.name).cast(f.dataType).alias(f.name) for f in INDEX if f.name in ("vector", "cluster_id", "cluster_distance"))
        unlike = named.join(placed, "id").select("source", "chunk_index", *typed)
    chosen = unlike.groupBy("source").agg(F.collect_list(F.struct(*unlike.columns[1:])).alias("chosen"))  # a text's own chunks
    kept = write_table(chosen.observe(stayed, F.coalesce(F.sum(F.size("chosen")), F.lit(0)).alias("kept")), "kept-chunks", compression="zstd")
    made = chosen_chunks(gathered(texts, kept, before, seen.get["size"]), window=window, dim=dim)
    known = todo.join(kept.select("source", F.size("chosen").alias("chunks")), "source", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    measured = lambda: {n: x for n, x in seen.get.items() if n != "size"} | {"sources": todo.count()} | cut.get | stayed.get | {"seconds": round(time.monotonic() - began, 3)}
    return tables.change(spark, before, {"chunks": made, "sources": known.select(*LEDGER.names)}, changed, mark, measured, gathered=True)


def _anchors(spark: SparkSession, before: tables.Snapshot, changed: DataFrame, touched: set[int]) -> nearness.Blocks:
    """Blocks of the vectors of all chunks but those of changed sources; only their buckets are blocked anew."""
    others = {b for b in range(before.buckets) if b not in touched}
    stored = before.anchors(spark, others)
    if not touched or not before.pivots:
        return stored
    left = nearness.unit_vectors(before.table(spark, "chunks", touched).join(changed, "source", "left_anti"))
    fresh = nearness.blocks_of(left, np.array(before.pivots))
    return nearness.Blocks(stored.table.unionByName(fresh.table), stored.pivots)


def stream_into(documents: DataFrame, path: str, checkpoint: str, stream: str = "documents", **how) -> StreamingQuery:
    """Index a stream of documents batch by batch, each exactly once; ``how`` as in ``index_batch``.

    The number of the last batch is part of the index's state, so a batch that is repeated
    after a failure is known, whatever the documents were.
    """

    def work(batch: DataFrame, number: int) -> None:
        index_batch(batch.sparkSession, batch, path, number, stream, **how)

    return documents.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
