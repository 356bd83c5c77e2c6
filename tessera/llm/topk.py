"""Exact top-k by inner product: block-at-a-time pruning over document-range blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded
from tessera.session import write_table

#: Vectors of a block, blocks of a page, pages of a sheet, queries of a chunk, pivots that order the vectors.
BLOCK, PAGE, SHEET, CHUNK, PIVOTS = 256, 16, 256, 128, 64
#: Chunks that meet a page (or a sheet) in one group, about.
TOGETHER = 16
#: Pages of each sheet scored first for each query, to have a k-th score to prune by.
FIRST = 2
_LEAST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``row, vec_id, terms``: a number and each component x as floor(scale * x), per row.

    Vectors that are null, or hold a null, NaN or infinite component, and null ids take no
    part. Rows that repeat an id are rows of their own. A component times ``scale`` beyond 64
    bits is held at their end, and products of components above 2**31 can wrap: such vectors
    aren't meant to be scored here.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    terms = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return fit.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms"))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with 0."""
    offsets = lists.offsets.to_numpy()
    sizes, values = np.diff(offsets), lists.values.to_numpy()[offsets[0] : offsets[-1]]
    out = np.zeros((len(lists), max(width or 0, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _pack(matrix: np.ndarray) -> bytes:
    small = matrix.size == 0 or (matrix.min() >= -(1 << 15) and matrix.max() < 1 << 15)
    return (b"s" if small else b"l") + matrix.astype(np.int16 if small else np.int64).tobytes()


def _unpack(blob: bytes, rows: int) -> np.ndarray:
    values = np.frombuffer(blob, np.int16 if blob[:1] == b"s" else np.int64, offset=1)
    return values.reshape(rows, -1).astype(np.int64)


def _stacked(blobs: list[bytes]) -> np.ndarray:
    """One vector a blob, shorter ones filled up with 0."""
    rows = [_unpack(b, 1)[0] for b in blobs]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows; by floating point where 53 bits hold them."""
    width = max(left.shape[1], right.shape[1])
    left, right = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (left, right))
    if float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(width, 1) < 2**53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block the sum over terms of the most that any vector of the block can add."""
    return products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)


def _grouped(vectors: DataFrame, pivots: np.ndarray, size: int, name: str) -> DataFrame:
    """Blocks of ``size`` vectors: ``block, n, rows, ids, terms, high, low``, written as a table.

    The vectors are ordered by their best pivot and its product, so a block's range holds
    vectors that are alike and its term maxima and minima are close to them.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dots = products(_matrix(batch.column("terms")), shipped.value)
            best = dots.argmax(axis=1) if dots.shape[1] else np.zeros(len(dots), np.int64)
            near = dots[np.arange(len(dots)), best] if dots.shape[1] else best
            yield batch.append_column("cell", pa.array(best)).append_column("near", pa.array(near))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rest = TaskContext.get().partitionId() << 32, None
        schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("rows", "ids", "terms", "high", "low"))])

        def emit(table: pa.Table):
            nonlocal number
            rows, ids = (table.column(c).combine_chunks().to_numpy().astype(np.int64) for c in ("row", "vec_id"))
            terms = _matrix(table.column("terms").combine_chunks())
            values = [number, len(ids), rows.tobytes(), ids.tobytes(), _pack(terms), _pack(terms.max(axis=0)[None]), _pack(terms.min(axis=0)[None])]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            while rest.num_rows >= size:
                yield emit(rest.slice(0, size))
                rest = rest.slice(size)
        if rest is not None and rest.num_rows:
            yield emit(rest)

    placed = vectors.transform(bounded).mapInArrow(place, "row bigint, vec_id bigint, terms array<bigint>, cell bigint, near bigint")
    keys = ("cell", "near", "vec_id", "row")
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return write_table(ordered.select("row", "vec_id", "terms").transform(bounded).mapInArrow(cut, "block bigint, n int, rows binary, ids binary, terms binary, high binary, low binary"), name)


def _paged(blocks: DataFrame, size: int, inner: str, outer: str) -> DataFrame:
    """``blocks`` with the number of the page (``outer``) of ``size`` neighbours that each belongs to.

    A block's number is its partition and its place in it, so neighbours stay together.
    """
    within = F.floor(F.col(inner).bitwiseAND(F.lit((1 << 32) - 1)) / size)
    return blocks.withColumn(outer, (F.shiftright(inner, 32) * F.lit(1 << 32) + within).cast("long"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query, exactly.

    Candidates are all rows of ``vectors`` but the query's own; ties go to the smaller id.
    Rows that repeat an id are rows of their own, as candidates and as queries.

    Blocks hold ranges of similar vectors with each term's maximum and minimum, neighbouring
    blocks make pages, and pages sheets. The summed term maxima of a page bound the scores of
    a query in it: each query's FIRST best pages of a sheet give it a k-th score, and then only
    chunks of queries and pages are written and met whose bound reaches that. Within a page
    the blocks come in the order of their own bounds, and are scored through their forward
    index (the terms of their vectors) until the bounds fall below the k-th score.

    Sheets and pages meet chunks in groups by number; each is dealt to as many salts as the
    number of chunks asks for (TOGETHER chunks a group), so tasks grow in number with the
    table and not in size.

    See ``quantised`` for rows that take no part. Vectors of different length are compared as
    if filled up with zeros. A query with fewer than k candidates gets them all, an empty
    table gives no rows; other columns aren't read.
    """
    table = write_table(quantised(vectors), "terms")
    some = table.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id", "terms").limit(PIVOTS).select("terms").toArrow()
    pivots = _matrix(some.column("terms").combine_chunks()) if some.num_rows else np.zeros((0, 1), np.int64)
    blocks = _grouped(table, pivots, BLOCK, "blocks").transform(_paged, PAGE, "block", "page").transform(_paged, SHEET, "page", "sheet")
    chunks = _grouped(table.filter(is_query), pivots, CHUNK, "chunks").select(
        F.col("block").alias("chunk"), F.col("n").alias("q_n"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("terms").alias("q_terms")
    )
    salts = max(1, -(-chunks.count() // TOGETHER))
    salted = chunks.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")

    def summary(key: tuple[pa.Scalar, ...], page: pa.Table) -> pa.Table:
        high, low = _stacked(page.column("high").to_pylist()), _stacked(page.column("low").to_pylist())
        # a vector shorter than the widest one has zeros there, so 0 is within the bounds of a filled-up block
        return pa.table({"sheet": [key[0].as_py()], "page": [key[1].as_py()], "high": [_pack(high.max(axis=0)[None])], "low": [_pack(low.min(axis=0)[None])]})

    pages = write_table(
        blocks.select("sheet", "page", "high", "low").groupBy("sheet", "page").applyInArrow(summary, "sheet bigint, page bigint, high binary, low binary"), "pages"
    )
    sheets = pages.select("sheet", "page", "high", "low", every_salt)
    numbers = sorted(r["sheet"] for r in pages.select("sheet").distinct().collect())  # one for SHEET * PAGE * BLOCK vectors

    def choose(floors: bool):
        """Chunks and pages worth scoring: the FIRST of each query, or the others that reach its floor."""

        def run(key: tuple[pa.Scalar, ...], sheet: pa.Table, asked: pa.Table) -> pa.Table:
            out: dict[str, list] = {"chunk": [], "page": [], "wanted": []}
            if sheet.num_rows:
                sheet = sheet.sort_by("page")
                own = sheet.column("page").to_pylist()
                high, low = _stacked(sheet.column("high").to_pylist()), _stacked(sheet.column("low").to_pylist())
                for row in asked.to_pylist():
                    found = bounds(_unpack(row["q_terms"], row["q_n"]), high, low)
                    wanted = np.zeros(found.shape, bool)
                    np.put_along_axis(wanted, np.argsort(-found, axis=1, kind="stable")[:, :FIRST], True, axis=1)
                    if floors:
                        wanted = ~wanted & (found >= _floor(row)[:, None])
                    for page in np.flatnonzero(wanted.any(axis=0)):
                        out["chunk"].append(row["chunk"])
                        out["page"].append(own[page])
                        out["wanted"].append(wanted[:, page].tobytes())
            return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "page": pa.array(out["page"], pa.int64()), "wanted": pa.array(out["wanted"], pa.binary())})

        return run

    def scored(chosen: DataFrame, asked: DataFrame) -> DataFrame:
        """Candidates of the chosen chunks and pages, which meet in groups by page and salt."""
        wanted = chosen.join(asked, "chunk")
        held = wanted.select(F.col("page").alias("at_page"), F.col("salt").alias("at_salt")).distinct()
        right = blocks.select("page", "n", "rows", "ids", "terms", "high", "low").join(held, F.col("page") == F.col("at_page"))

        def meet(key: tuple[pa.Scalar, ...], page: pa.Table, chunk_rows: pa.Table) -> pa.Table:
            return _score(page.to_pylist(), chunk_rows.to_pylist(), k)

        return right.groupBy("at_page", "at_salt").cogroup(wanted.groupBy("page", "salt")).applyInArrow(meet, "query_row bigint, query_id bigint, vec_id bigint, vec_row bigint, score bigint")

    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "vec_row")
    schema = "chunk bigint, page bigint, wanted binary"
    unfloored = salted.withColumn("floor", F.lit(None).cast("binary"))

    def chosen_of(asked: DataFrame, floors: bool, name: str) -> DataFrame:
        placed = asked.withColumn("sheet", F.explode(F.array(*map(F.lit, numbers)).cast("array<bigint>")))
        return write_table(sheets.groupBy("sheet", "salt").cogroup(placed.groupBy("sheet", "salt")).applyInArrow(choose(floors), schema), name)

    early = write_table(scored(chosen_of(unfloored, False, "first-pages"), unfloored), "early-scores")
    kth = early.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_row", F.col("score").alias("kth"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = np.frombuffer(row["q_rows"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), row["chunk"])), pa.array(rows)], names=["chunk", "query_row"])

    def floors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = {x["query_row"]: x["kth"] for x in row["known"] or []}
                floor = np.array([known.get(i, _LEAST) for i in np.frombuffer(row["q_rows"], np.int64).tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([floor.tobytes()])], names=["chunk", "floor"])

    in_chunk = chunks.select("chunk", "q_rows").transform(bounded).mapInArrow(members, "chunk bigint, query_row bigint").join(kth, "query_row")
    known = in_chunk.groupBy("chunk").agg(F.collect_list(F.struct("query_row", "kth")).alias("known"))  # CHUNK entries at most
    floor = write_table(chunks.select("chunk", "q_rows").join(known, "chunk", "left").transform(bounded).mapInArrow(floors_of, "chunk bigint, floor binary"), "floors")
    floored = salted.join(floor, "chunk")
    every = early.union(scored(chosen_of(floored, True, "other-pages"), floored))
    ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _floor(row: dict) -> np.ndarray:
    return np.frombuffer(row["floor"], np.int64).copy() if row["floor"] else np.full(row["q_n"], _LEAST)


def _score(page: list[dict], asked: list[dict], k: int) -> pa.Table:
    """Candidates of each chunk's wanted queries in the blocks of a page.

    Blocks come in falling order of their best bound. A query whose bound is below its k-th
    score so far (or its floor) is left out; when no block is left that reaches it, all is done.
    """
    names = ("query_row", "query_id", "vec_id", "vec_row", "score")
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 5]
    held = [(np.frombuffer(b["rows"], np.int64), np.frombuffer(b["ids"], np.int64), _unpack(b["terms"], b["n"])) for b in page]
    high, low = (_stacked([b[c] for b in page]) for c in ("high", "low"))
    for row in asked:
        rows, ids, queries = np.frombuffer(row["q_rows"], np.int64), np.frombuffer(row["q_ids"], np.int64), _unpack(row["q_terms"], row["q_n"])
        wanted, kth, found = np.frombuffer(row["wanted"], bool), _floor(row), np.full((row["q_n"], k), _LEAST)
        limits = bounds(queries, high, low)
        for b in np.argsort(-np.where(wanted[:, None], limits, _LEAST).max(axis=0), kind="stable"):
            live = np.flatnonzero(wanted & (limits[:, b] >= kth))
            if not len(live):
                continue
            other_rows, other_ids, terms = held[b]
            scores = products(queries[live], terms)
            own = rows[live][:, None] == other_rows[None, :]
            spread = lambda x, shape=scores.shape: np.broadcast_to(x, shape)
            order = np.lexsort((spread(other_rows), spread(other_ids), np.where(own, np.iinfo(np.int64).max, -scores)), axis=1)[:, :k]
            best = np.take_along_axis(scores, order, 1)
            keep = (other_rows[order] != rows[live][:, None]) & (best >= kth[live][:, None])
            merged = np.sort(np.concatenate([found[live], np.where(keep, best, _LEAST)], axis=1), axis=1)[:, -k:]
            found[live] = merged
            kth[live] = np.maximum(kth[live], merged[:, 0])
            q, c = np.nonzero(keep)
            out.append([rows[live][q], ids[live][q], other_ids[order][q, c], other_rows[order][q, c], best[q, c]])
    return pa.table({n: pa.array(np.concatenate(x)) for n, x in zip(names, zip(*out, strict=True), strict=True)})


ORACLE = r"""
WITH fit AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)::BIGINT) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM fit q JOIN fit c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM pairs) WHERE rank <= 5
"""
