"""Stored postings: a table of terms in blocks of documents with the blocks' maxima, for BM25 without reading texts.

A row is a term of a field in a block of documents: their ids, counts and lengths, and the largest
count and least length, which bound what a query can get from the block. ``tables``'s manifests list the
segments, so an append is one new segment, and readers see it whole or not at all. Document
frequencies and lengths are sums over the rows, whatever the segments.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import terms
from tessera.operators import bm25
from tessera.operators.vector import best_of
from tessera.session import bounded, write_table
from tessera.sources import tables

#: Documents of a block at most (fewer where texts are long: a batch to Python is bounded in bytes), and buckets of terms.
BLOCK, BUCKETS = 1024, 64
#: Bytes of rows that a task packs at once for the shuffle by bucket.
PACKED_BYTES = 32 * 1024 * 1024
#: The term of the rows that count a block's documents; texts have no such term.
ALL = ""
#: Scores are rounded to six digits, so a bound within this of a score may tie with it.
SLACK = 2e-6


def bucket(term: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, path: str) -> dict:
    names = [n for n in tables.names(spark, f"{path}/manifests") if n.endswith(".json")]
    if not names:
        return {"version": 0, "segments": [], "fields": None, "kind": None, "batches": {}}
    return json.loads(spark.read.text(f"{path}/manifests/{names[-1]}", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, before: dict, **changed: object) -> None:
    after = before | changed | {"version": before["version"] + 1}
    tables.publish(spark, path, after["version"], json.dumps(after))


def _schema(kind: str) -> str:
    return f"term string, field int, block bigint, n bigint, total bigint, max_tf int, min_dl int, ids array<{kind}>, tf array<int>, dl array<int>, bucket int"


def _rows(spark: SparkSession, path: str, state: dict) -> DataFrame:
    """The rows of all segments; a block's number is its own among them."""
    held = spark.read.schema(_schema(state["kind"]) + ", segment string").option("basePath", f"{path}/segments").parquet(*(f"{path}/segments/{s}" for s in state["segments"]))
    return held.withColumn("block", F.xxhash64("segment", "block")).drop("segment")


def _write(rows: DataFrame, path: str) -> str:
    name = f"segment={uuid.uuid4().hex}"
    # a bucket's rows lie together by term, so that a few terms are a few pages; large buckets are split by size
    dealt = _unpacked(_packed(rows).hint("rebalance", F.col("bucket")), rows)
    dealt.sortWithinPartitions("bucket", "term", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/segments/{name}")
    return name


def _packed(rows: DataFrame) -> DataFrame:
    """``bucket, rows``: rows of a bucket as compressed columns; most lists are short, and as rows of a shuffle each would take several times its own bytes."""
    columns = [c for c in rows.columns if c != "bucket"]

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        together = pa.Table.from_batches(held)
        own = together.column("bucket").to_numpy()
        order = np.argsort(own, kind="stable")
        together, own = together.select(columns).take(pa.array(order)).combine_chunks(), own[order]
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        bodies = []
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True):
            body = pa.BufferOutputStream()
            with pa.ipc.new_stream(body, together.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as into:
                into.write_table(together.slice(lo, hi - lo))
            bodies.append(body.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(own[edges], pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACKED_BYTES:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return bounded(rows).mapInArrow(run, "bucket int, rows binary")


def _unpacked(packed: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of ``_packed``, which were rows of ``like``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
                for part in pa.ipc.open_stream(body.as_buffer()):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, bucket, np.int32))], names=[*part.schema.names, "bucket"])

    fields = [f for f in like.schema if f.name != "bucket"]
    return bounded(packed).mapInArrow(run, StructType([*fields, like.schema["bucket"]]))


def _blocked(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """The rows of ``chunks(id, *fields)``: each slice of a batch is a block, so nothing is shuffled to make them."""
    kind = chunks.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                for f in range(len(fields)):
                    yield _block(part.column("id"), part.column(f"t{f}"), f, part.column("_row")[0].as_py())

    listed = chunks.select("id", F.monotonically_increasing_id().alias("_row"), *(terms(F.col(c)).alias(f"t{f}") for f, c in enumerate(fields)))
    made = bounded(listed).mapInArrow(cut, _schema(kind).removesuffix(", bucket int"))
    return made.withColumn("bucket", bucket("term"))


def _block(ids: pa.Array, lists: pa.Array, field: int, block: int) -> pa.RecordBatch:
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cells, tf = np.unique(codes * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    own, doc = cells // len(ids), cells % len(ids)
    edges = np.searchsorted(own, np.arange(len(words) + 1))
    dl = lengths[doc]
    sums, most, least = (x if len(words) else np.zeros(0, np.int64) for x in _reduced(edges, tf, dl))
    ends = pa.array(np.append(edges, edges[-1]).astype(np.int32))  # the last row, of all documents, lists none
    columns = {
        "term": pa.concat_arrays([words.cast(pa.string()), pa.array([ALL])]),
        "field": pa.array(np.full(len(words) + 1, field, np.int32)),
        "block": pa.array(np.full(len(words) + 1, block, np.int64)),
        "n": pa.array(np.append(np.diff(edges), len(ids))),
        "total": pa.array(np.append(sums, lengths.sum())),
        "max_tf": pa.array(np.append(most, 0).astype(np.int32)),
        "min_dl": pa.array(np.append(least, 0).astype(np.int32)),
        "ids": pa.ListArray.from_arrays(ends, ids.take(pa.array(doc))),
        "tf": pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))),
        "dl": pa.ListArray.from_arrays(ends, pa.array(dl.astype(np.int32))),
    }
    return pa.RecordBatch.from_pydict(columns)


def _reduced(edges: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = edges[:-1]
    return (np.add.reduceat(tf, at), np.maximum.reduceat(tf, at), np.minimum.reduceat(dl, at)) if len(at) else (at, at, at)


def append(chunks: DataFrame, path: str, fields: str | list[str] = "text", batch: tuple[str, int] | None = None) -> None:
    """Add ``chunks(id, *fields)`` to the postings at ``path``, as one segment.

    Ids are the caller's and new to the index. A null text has no terms but counts as a document; an
    empty table changes nothing. ``batch`` is the stream and number of the batch that the rows are: a batch that
    the index has is left out, so a replay adds nothing. Raises if somebody else has changed the index meanwhile, or
    for other fields or another type of id than it has.
    """
    spark, fields = chunks.sparkSession, [fields] if isinstance(fields, str) else list(fields)
    state, kind = _state(spark, path), chunks.schema["id"].dataType.simpleString()
    if state["fields"] and (state["fields"], state["kind"]) != (fields, kind):
        raise ValueError(f"the postings have fields {state['fields']} and ids of {state['kind']}")
    if batch and state["batches"].get(batch[0], -1) >= batch[1]:
        return
    if chunks.isEmpty():
        return
    _publish(spark, path, state, segments=[*state["segments"], _write(_blocked(chunks, fields), path)], fields=fields, kind=kind, batches=state["batches"] | (dict([batch]) if batch else {}))


def compact(spark: SparkSession, path: str) -> None:
    """Make one segment of all, and blocks of about BLOCK documents of those that have less than half as many."""
    state = _state(spark, path)
    if not state["segments"]:
        return
    rows = _rows(spark, path, state)
    sizes = write_table(rows.filter((F.col("bucket") == bucket(F.lit(ALL))) & (F.col("term") == ALL) & (F.col("field") == 0)).groupBy("block").agg(F.sum("n").alias("docs")), "blocks")
    small = sizes.filter(F.col("docs") * 2 < BLOCK)
    groups = -(-(small.agg(F.sum("docs")).first()[0] or 0) // BLOCK) or 1
    regrouped = rows.join(small.select("block"), "block", "left_semi").withColumn("block", F.pmod(F.xxhash64("block"), F.lit(groups)))
    lists = {c: F.flatten(f"parts.{c}").alias(c) for c in ("ids", "tf", "dl")}
    merged = regrouped.groupBy("bucket", "term", "field", "block").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), F.collect_list(F.struct("ids", "tf", "dl")).alias("parts")
    )  # a group has about BLOCK documents
    kept = rows.join(small.select("block"), "block", "left_anti")
    _publish(spark, path, state, segments=[_write(kept.unionByName(merged.select(*(lists.get(c, F.col(c)) for c in kept.columns))), path)])


def term_statistics(spark: SparkSession, path: str) -> DataFrame:
    """``field, term, df, total``: the documents that have each term, and how often it stands in all; no list is read."""
    state = _state(spark, path)
    if not state["segments"]:
        return spark.createDataFrame([], "field int, term string, df bigint, total bigint")
    rows = _rows(spark, path, state).filter(F.col("term") != ALL)
    return rows.groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("total").alias("total"))


def search(spark: SparkSession, path: str, queries: DataFrame, limit: int = 10, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
    """``query_id, id, score, rank``: what ``bm25.search`` gives over the chunks that were appended.

    Only rows of terms that a query asks for are read; they are shuffled by block. A task goes
    through its blocks with the best of each query so far, and scores a block for those queries only
    whose bound there reaches their ``limit``-th score. What it holds grows with the hits, not with
    chunks times queries. Query batches of more than ``bm25.ASKED`` entries go in parts.
    """
    state = _state(spark, path)
    asked = write_table(bm25.asked_terms(queries), "asked")
    if not state["segments"]:
        return spark.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, id bigint, score double, rank int")
    parts = max(1, -(-asked.count() // bm25.ASKED))
    share = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    found = [_scored(_rows(spark, path, state), asked.filter(share == i) if parts > 1 else asked, len(state["fields"]), limit, k1, b) for i in range(parts)]
    return bm25.best(reduce(DataFrame.unionByName, found), limit)


def _scored(rows: DataFrame, asked: DataFrame, fields: int, limit: int, k1: float, b: float) -> DataFrame:
    spark = rows.sparkSession
    vocabulary, by_term, ids = bm25.asked_model(asked.toArrow())  # ASKED entries at most
    size, kind = len(vocabulary), rows.schema["ids"].dataType.elementType.simpleString()
    wanted = write_table(asked.select("term").distinct().withColumn("bucket", bucket("term")), "wanted")
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # BUCKETS at most
    every = rows.filter((F.col("bucket") == bucket(F.lit(ALL))) & (F.col("term") == ALL)).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a row a field
    met = rows.filter(F.col("bucket").isin(buckets)).join(wanted, ["bucket", "term"], "left_semi")
    frequent = met.groupBy("field", "term").agg(F.sum("n").alias("df")).toArrow()  # a row an asked term and field
    mean, many = np.ones(fields), 0
    for r in every:
        mean[r["field"]], many = r["total"] / r["n"] or 1.0, r["n"]
    df = np.zeros(size * fields)
    df[_codes(frequent.column("field"), frequent.column("term"), vocabulary)] = frequent.column("df").to_numpy()
    model = spark.sparkContext.broadcast((vocabulary, by_term, ids, np.log(1 + (many - df + 0.5) / (df + 0.5)), mean))

    def weight(idf: np.ndarray, tf: np.ndarray, dl: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (starts, which, qtf), names, idf, mean = model.value
        reached = np.full(len(names), -np.inf)
        held: list[tuple[np.ndarray, ...]] = []
        fresh = 0
        for block in _blocks(batches):
            codes = _codes(block.column("field"), block.column("term"), words)
            term, n = codes % size, block.column("n").to_numpy().astype(np.int64)
            field = codes // size
            bound = weight(idf[codes], block.column("max_tf").to_numpy().astype(np.float64), block.column("min_dl").to_numpy(), mean[field])
            askers = starts[term + 1] - starts[term]
            pick = np.repeat(starts[term] - (np.cumsum(askers) - askers), askers) + np.arange(int(askers.sum()))
            row, query, times = np.repeat(np.arange(len(codes)), askers), which[pick], qtf[pick]
            own, place = np.unique(query, return_inverse=True)
            alive = np.bincount(place, bound[row] * times, len(own)) >= reached[own] - SLACK
            order = np.flatnonzero(alive[place])
            order = order[np.argsort(place[order], kind="stable")]
            row, query, times = row[order], query[order], times[order]
            lists = block.column("ids").combine_chunks()
            docs, at = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            edges = np.cumsum(n) - n
            tf, dl = (block.column(c).combine_chunks().flatten().to_numpy().astype(np.float64) for c in ("tf", "dl"))
            w = weight(np.repeat(idf[codes], n), tf, dl, np.repeat(mean[field], n))
            hits = n[row]
            upto = np.cumsum(hits)
            lo = 0
            while lo < len(row):  # whole queries of about CELLS hits
                hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + bm25.CELLS, "right"))
                hi = int(np.searchsorted(query, query[max(hi, lo + 1) - 1], "right"))
                h, q = hits[lo:hi], query[lo:hi]
                posting = np.repeat(edges[row[lo:hi]] - (np.cumsum(h) - h), h) + np.arange(int(h.sum()))
                keys, cell = np.unique(np.repeat(q, h) * len(docs) + at[posting], return_inverse=True)
                total = np.round(np.bincount(cell, w[posting] * np.repeat(times[lo:hi], h), len(keys)), 6)
                keep = total >= reached[keys // len(docs)]
                best = best_of([(keys[keep] // len(docs), docs[keys[keep] % len(docs)], total[keep])], limit)
                rank = np.arange(len(best[0])) - np.searchsorted(best[0], best[0])
                full = rank == limit - 1
                reached[best[0][full]] = np.maximum(reached[best[0][full]], best[2][full])
                held.append(best)
                fresh += len(best[0])
                lo = hi
            if fresh > max(10_000, len(held[0][0]) if held else 0):
                held, fresh = [best_of(held, limit)], 0
                rank = np.arange(len(held[0][0])) - np.searchsorted(held[0][0], held[0][0])
                reached[held[0][0][rank == limit - 1]] = held[0][2][rank == limit - 1]
        if held:
            q, found, values = best_of(held, limit)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(found), pa.array(values)], names=["query_id", "id", "score"])

    dealt = bounded(met.select("term", "field", "block", "n", "max_tf", "min_dl", "ids", "tf", "dl").repartition("block").sortWithinPartitions("block"))
    return dealt.mapInArrow(score, f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {kind}, score double")


def _codes(field: pa.Array, term: pa.Array, words: pa.Array) -> np.ndarray:
    return field.to_numpy().astype(np.int64) * len(words) + pc.index_in(term, value_set=words).to_numpy().astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, of batches in order of block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                if held and held[0].column("block")[0].as_py() != numbers[lo]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
