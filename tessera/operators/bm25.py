"""BM25: postings, statistics and batch search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import terms
from tessera.operators.vector import best_of
from tessera.session import bounded, ship, write_table

#: The usual constants.
K1, B = 1.2, 0.75
#: Entries (query and term) of a batch of queries that are broadcast at most; above, terms meet in a join.
ASKED = 2_000_000
#: Cells (chunk and query) that a task scores at once: some ten arrays of so many numbers are alive then.
CELLS = 500_000


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``id, term, tf, dl`` for ``chunks(id, text)``: one row per chunk and distinct term."""
    listed = chunks.select("id", terms(F.col(text)).alias("t"))
    exploded = listed.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return exploded.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")


def best(hits: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def search(chunks: DataFrame, queries: DataFrame, limit: int = 10, text: str | list[str] = "text", k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, id, score, rank``: the best ``limit`` chunks of each query, ties by id.

    Over several text fields a chunk's score is the sum over its fields, each with its own
    statistics. A term that a query repeats counts each time.

    One pass over the texts cuts every chunk's terms down to those that a query asks for, as
    numbers, and writes that as a small table; nothing is shuffled. Document frequencies and
    lengths are sums over it. Then each task scores its chunks against all queries and hands
    on the best ``limit`` of each query only. What goes to the tasks are the queries' own terms;
    with more than ASKED of them the terms meet the chunks in a join instead.
    """
    fields = [text] if isinstance(text, str) else text
    asked = write_table(asked_terms(queries), "asked")
    if asked.count() > ASKED:
        return best(_joined_scores(chunks, asked, fields, k1, b), limit)
    return best(_packed_scores(chunks, asked, fields, limit, k1, b), limit)


def asked_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf`` of ``queries(query_id, query)``."""
    return queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def asked_model(own: pa.Table) -> tuple[pa.Array, tuple[np.ndarray, ...], pa.Array]:
    """The distinct terms of asked entries, who asks for each and how often (edges, queries, counts), and the queries' ids."""
    coded = own.column("term").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    vocabulary, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = own.column("query_id").combine_chunks()
    ids = pc.unique(names)
    which = pc.index_in(names, value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((which, codes))
    by_term = (np.searchsorted(codes[order], np.arange(len(vocabulary) + 1)), which[order], own.column("qtf").to_numpy()[order].astype(np.float64))
    return vocabulary, by_term, ids


def _joined_scores(chunks: DataFrame, asked: DataFrame, fields: list[str], k1: float, b: float) -> DataFrame:
    """Scores of all hits by joins on the terms, for query batches of any size."""
    wanted, every = asked.select("term").distinct(), None
    for field in fields:
        listed = chunks.select("id", terms(F.col(field)).alias("t")).withColumn("dl", F.size("t"))
        totals = listed.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        found = listed.select("id", "dl", F.explode("t").alias("term")).join(wanted, "term").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        df = found.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        per_term = df.join(F.broadcast(totals), how="cross").select("term", "avgdl", idf.alias("idf"))  # one row of totals
        scored = found.join(per_term, "term").select("id", "term", (F.col("idf") * weight).alias("w"))
        hits = scored.join(asked, "term").select("query_id", "id", (F.col("w") * F.col("qtf")).alias("w"))
        every = hits if every is None else every.union(hits)
    return every.groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))


def _packed_scores(chunks: DataFrame, asked: DataFrame, fields: list[str], limit: int, k1: float, b: float) -> DataFrame:
    """The best ``limit`` of each query in each task's chunks, by the queries' terms in every task."""
    spark = chunks.sparkSession
    ship(spark)
    vocabulary, by_term, ids = asked_model(asked.toArrow())  # ASKED entries at most
    words = spark.sparkContext.broadcast(vocabulary)
    size = len(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's lengths, and the numbers of its asked terms (of all fields, one after the other) with their counts."""
        for batch in batches:
            rows, codes, lengths = [], [], []
            for f in range(len(fields)):
                lists = batch.column(f"t{f}")
                lengths.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                at = pc.index_in(lists.flatten(), value_set=words.value)
                kept = at.is_valid().to_numpy(zero_copy_only=False)
                rows.append(np.repeat(np.arange(batch.num_rows), lengths[-1])[kept])
                codes.append(at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) + f * size)
            pairs, counts = np.unique(np.concatenate(rows) * (size * len(fields)) + np.concatenate(codes), return_counts=True)
            edges = pa.array(np.searchsorted(pairs, np.arange(batch.num_rows + 1) * (size * len(fields))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (pairs % (size * len(fields)), counts)]
            stacked = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(lengths, axis=1).ravel()), len(fields)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), stacked, *lists], names=["id", "dl", "codes", "tf"])

    kind, asker = chunks.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    listed = chunks.select("id", *(terms(F.col(c)).alias(f"t{f}") for f, c in enumerate(fields)))
    table = write_table(bounded(listed).mapInArrow(cut, f"id {kind}, dl array<bigint>, codes array<int>, tf array<int>"), "postings")
    totals = table.agg(F.count("*").alias("n"), *(F.avg(F.col("dl")[f]).alias(f"avg{f}") for f in range(len(fields)))).first()
    frequencies = table.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).toPandas()  # a row an asked term and field
    df = np.zeros(size * len(fields))
    df[frequencies["code"].to_numpy()] = frequencies["df"]
    idf = np.log(1 + (totals["n"] - df + 0.5) / (df + 0.5))
    mean = np.array([totals[f"avg{f}"] or 1.0 for f in range(len(fields))])
    model = spark.sparkContext.broadcast((by_term, ids, idf, mean))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (starts, which, qtf), ids, idf, mean = model.value
        if not len(ids):
            return
        step = max(1, CELLS // max(len(ids), 1))
        held: list[tuple[np.ndarray, ...]] = []
        taken = 0
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.num_rows
                lists = part.column("codes")
                codes, tf = lists.flatten().to_numpy().astype(np.int64), part.column("tf").flatten().to_numpy().astype(np.float64)
                row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                dl = part.column("dl").flatten().to_numpy().reshape(n, -1)
                field, term = codes // size, codes % size
                w = idf[codes] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row, field] / mean[field]))
                many = starts[term + 1] - starts[term]
                pick = np.repeat(starts[term] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                cells = np.repeat(row, many) * len(ids) + which[pick]
                total = np.bincount(cells, np.repeat(w, many) * qtf[pick], n * len(ids)).reshape(n, -1)
                hit = np.bincount(cells, minlength=n * len(ids)).reshape(n, -1) > 0
                scores = np.where(hit, np.round(total, 6), -np.inf).T
                own = part.column("id").to_numpy(zero_copy_only=False)
                best = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :limit]
                values = np.take_along_axis(scores, best, 1)
                q, c = np.nonzero(values > -np.inf)
                held.append((q, own[best[q, c]], values[q, c]))
                taken += len(q)
                if taken > 4 * limit * len(ids) + CELLS:
                    held = [best_of(held, limit)]
                    taken = len(held[0][0])
        if held:
            q, own, values = best_of(held, limit)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(own), pa.array(values)], names=["query_id", "id", "score"])

    return bounded(table).mapInArrow(score, f"query_id {asker}, id {kind}, score double")


def search_fields(chunks: DataFrame, queries: DataFrame, fields: list[str], limit: int = 10) -> DataFrame:
    """``search`` over several text fields."""
    return search(chunks, queries, limit, fields)
