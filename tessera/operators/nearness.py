"""Vectors that are near each other, by blocks whose angles to some pivots bound them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import numbered
from tessera.session import bounded, write_table

#: Vectors whose angles bound those of blocks; rows of a block; blocks whose bounds are compared in one task.
PIVOTS, BLOCK_ROWS, SHEET_BLOCKS = 16, 1024, 512
#: Blocks of a tile's side at most (a task holds one side), and sides that the blocks make at least, so that there are tiles for all tasks.
SIDE_BLOCKS, SIDES = 32, 16
_BLOCK = "block bigint, ids binary, v binary, low array<double>, high array<double>"


@dataclass
class Blocks:
    """A table ``block, ids, v, low, high`` (and keys of its own), and the pivots that its angles are to."""

    table: DataFrame
    pivots: np.ndarray


def normalised(vector: Column) -> Column:
    """The vector at length one; a zero vector as it is."""
    length = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    # the length is bound by an array of one, else it is summed anew for each component
    scaled = lambda n: F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.transform(F.array(length), scaled)[0]


def whole(vector: Column) -> Column:
    """Whether a vector can be compared: it is there, and each component is a finite number."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, odd), F.lit(False))


def comparable(vectors: DataFrame, *keys: str) -> DataFrame:
    """``id, v`` (and ``keys``) of the vectors that can be compared, at length one."""
    return bounded(vectors).filter(whole(F.col("vector"))).select("id", normalised(F.col("vector")).alias("v"), *keys)


def same_length(sizes: DataFrame) -> None:
    """Raises ValueError if the vectors of these ``size`` differ in length."""
    least, most = sizes.agg(F.min("size"), F.max("size")).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components can't be compared")


def unit_vectors(vectors: DataFrame, *keys: str) -> DataFrame:
    """``comparable`` vectors as a table.

    Raises ValueError if they differ in length.
    """
    unit = write_table(comparable(vectors, *keys), "unit-vectors")
    same_length(unit.select(F.size("v").alias("size")))
    return unit


def pivots_of(unit: DataFrame) -> np.ndarray:
    """PIVOTS of the vectors, by hash."""
    some = unit.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").toArrow().column("v").to_pylist()
    return np.array(some, np.float64) if some else np.zeros((0, 0))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def blocks_of(unit: DataFrame, pivots: np.ndarray, block_rows: int = BLOCK_ROWS, keys: tuple[str, ...] = ()) -> Blocks:
    """Blocks of ``unit(id, v)``, ordered by nearest pivot and the angle to it, with the least and greatest angle to each.

    Rows of different ``keys`` (bigint) are in different blocks.
    """
    return Blocks(write_table(laid(unit, pivots, block_rows, keys), "blocks"), pivots)


def laid(unit: DataFrame, pivots: np.ndarray, block_rows: int = BLOCK_ROWS, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``blocks_of``, in order of ``keys``; they aren't written, so blocks that are read twice may get other numbers."""
    shipped = unit.sparkSession.sparkContext.broadcast(pivots)
    angles = lambda matrix: np.arccos(np.clip(matrix @ shipped.value.T, -1, 1)) if len(shipped.value) else np.zeros((len(matrix), 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = angles(_matrix(batch.column("v")))
                yield batch.append_column("cell", pa.array(own.argmin(axis=1))).append_column("angle", pa.array(own.min(axis=1)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rest = TaskContext.get().partitionId() << 32, None

        def emit(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            matrix = _matrix(part.column("v").combine_chunks())
            own, ids = angles(matrix), part.column("id").to_numpy().astype(np.int64)
            number += 1
            values = [number - 1, ids.tobytes(), matrix.tobytes(), own.min(axis=0), own.max(axis=0), *(part.column(k)[0].as_py() for k in keys)]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=["block", "ids", "v", "low", "high", *keys])

        def runs(table: pa.Table) -> list[int]:
            """Where runs of equal keys end."""
            edges = np.zeros(table.num_rows - 1, bool)
            for k in keys:
                own = table.column(k).to_numpy()
                edges |= own[1:] != own[:-1]
            return [*(np.flatnonzero(edges) + 1).tolist(), table.num_rows]

        for batch in batches:
            if not batch.num_rows:
                continue
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            start, ends = 0, runs(rest)
            for end in ends:
                while end - start >= block_rows or (end < ends[-1] and end > start):
                    yield emit(rest.slice(start, min(block_rows, end - start)))
                    start = min(start + block_rows, end)
            rest = rest.slice(start)
        if rest is not None and rest.num_rows:
            yield emit(rest)

    own_keys = "".join(f", {k} bigint" for k in keys)
    order = [*keys, "cell", "angle", "id"]
    ordered = unit.select("id", "v", *keys).mapInArrow(placed, f"id bigint, v array<double>{own_keys}, cell bigint, angle double").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("id", "v", *keys).mapInArrow(packed, _BLOCK + own_keys)


def _reach(threshold: float) -> float:
    """The angle that vectors of this cosine are apart at most; a zero vector has no angle, and no pair above 0."""
    return np.arccos(min(threshold, 1.0)) + 1e-6 if threshold > 0 else np.pi


def _met(one: Blocks, two: Blocks | None, threshold: float, sheet_blocks: int) -> DataFrame:
    """``i, j, side, block, ids, v, partners``: tiles of pairs of blocks that may hold near vectors; of ``one`` alone each pair once.

    The angle between unit vectors is a metric, so two blocks whose angles to some pivot lie
    further apart than the threshold's have no pair, and never meet. The bounds of blocks are
    compared sheet by sheet. What is left meets in tiles of up to SIDE_BLOCKS times SIDE_BLOCKS blocks, to which a
    block goes once, not once for each of its pairs: a tile's rows lie together, first (side 0) the blocks of ``two``, then
    those of ``one`` with the numbers of their partners.
    """
    reach, single = _reach(threshold), two is None
    other = one if two is None else two
    bounds = lambda blocks, n: blocks.table.select("block", "low", "high", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias("sheet"))
    sizes = [one.table.count()] * 2 if single else [b.table.count() for b in (one, other)]
    sheets = [max(1, -(-n // sheet_blocks)) for n in sizes]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if single:
        sides = bounds(one, sheets[0]).select("block", "low", "high", "sheet", every(sheets[0]).alias("other"))
        met = sides.select("block", "low", "high", F.least("sheet", "other").alias("one"), F.greatest("sheet", "other").alias("two"), (F.col("sheet") <= F.col("other")).alias("left"))
    else:
        left = bounds(one, sheets[0]).select("block", "low", "high", F.col("sheet").alias("one"), every(sheets[1]).alias("two"), F.lit(True).alias("left"))
        right = bounds(other, sheets[1]).select("block", "low", "high", every(sheets[0]).alias("one"), F.col("sheet").alias("two"), F.lit(False).alias("left"))
        met = left.unionByName(right)

    def close(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, left = table.column("block").to_numpy(), table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        low, high = (np.array(table.column(c).to_pylist()).reshape(len(names), -1) for c in ("low", "high"))
        same = single and key[0].as_py() == key[1].as_py()
        a, b = (np.arange(len(names)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        near = np.ones((len(a), len(b)), bool)
        for p in range(low.shape[1]):
            near &= (low[a, p][:, None] - high[b, p] <= reach) & (low[b, p] - high[a, p][:, None] <= reach)
        i, j = np.nonzero(near)
        first, second = names[a[i]], names[b[j]]
        keep = first <= second if same else np.ones(len(first), bool)
        return pa.table({"one": first[keep], "two": second[keep]})

    pairs = write_table(met.groupBy("one", "two").applyInArrow(close, "one bigint, two bigint"), "block-pairs")
    # blocks of neighbouring numbers are neighbours, so where few blocks meet, few tiles have any
    sides = [_sides(b, n) for b, n in ([(one, sizes[0])] if single else zip((one, other), sizes, strict=True))]
    tiles = pairs.join(sides[0].toDF("one", "i"), "one").join(sides[-1].toDF("two", "j"), "two")
    first = tiles.select("i", "j", F.col("two").alias("block")).distinct().withColumn("partners", F.lit(None).cast("array<bigint>"))
    second = tiles.groupBy("i", "j", F.col("one").alias("block")).agg(F.collect_list("two").alias("partners"))  # SIDE_BLOCKS at most
    rows = lambda asked, blocks, side: asked.join(blocks.table.select("block", "ids", "v"), "block").select("i", "j", F.lit(side).alias("side"), "block", "ids", "v", "partners")
    return rows(first, other, 0).unionByName(rows(second, one, 1)).repartition("i", "j").sortWithinPartitions("i", "j", "side", "block")


def _sides(blocks: Blocks, many: int) -> DataFrame:
    """``block, side``: about SIDE_BLOCKS blocks of neighbouring numbers to a side, fewer where that makes less than SIDES."""
    own = min(SIDE_BLOCKS, max(1, many // SIDES))
    return write_table(numbered(blocks.table.select("block"), "block").select("block", F.floor((F.col("position") - 1) / own).alias("side")), "sides")


def _mapped(met: DataFrame, work: Callable[[dict], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``work`` on each pair of blocks, with their ``product``; a task holds the blocks of one side of a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if tile != (row["i"], row["j"]):
                    tile, held = (row["i"], row["j"]), {}
                ids = np.frombuffer(row["ids"], np.int64)
                matrix = np.frombuffer(row["v"]).reshape(len(ids), -1)
                if row["side"] == 0:
                    held[row["block"]] = ids, matrix
                    continue
                for two in sorted(row["partners"]):
                    found = work({"one": row["block"], "two": two, "ids1": ids, "ids2": held[two][0], "product": matrix @ held[two][1].T})
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.values()], names=[*found])

    return bounded(met).mapInArrow(run, schema)


def links(blocks: Blocks, threshold: float, most: int | None = None, sheet_blocks: int = SHEET_BLOCKS) -> DataFrame:
    """``a, b, similarity``: pairs of ids (a < b) whose cosine is at least ``threshold``, each once.

    A pair of blocks with more than ``most`` of them gives only its b's, with a null a.
    """

    def work(row: dict) -> dict[str, np.ndarray]:
        ids1, ids2, product = row["ids1"], row["ids2"], row["product"]
        near = product >= threshold
        if row["one"] == row["two"]:
            near &= ids1[:, None] < ids2[None, :]
        i, j = np.nonzero(near)
        a, b = np.minimum(ids1[i], ids2[j]), np.maximum(ids1[i], ids2[j])
        if most is not None and len(a) > most:
            later = np.unique(b)
            return {"a": pa.nulls(len(later), pa.int64()), "b": later, "similarity": pa.nulls(len(later), pa.float64())}
        return {"a": a, "b": b, "similarity": product[i, j]}

    return _mapped(_met(blocks, None, threshold, sheet_blocks), work, "a bigint, b bigint, similarity double")


def near_any(blocks: Blocks, anchors: Blocks, threshold: float, sheet_blocks: int = SHEET_BLOCKS) -> DataFrame:
    """``id`` of the rows of ``blocks`` that are near some row of ``anchors``; a row may come more than once."""

    def work(row: dict) -> dict[str, np.ndarray]:
        return {"id": row["ids2"][(row["product"] >= threshold).any(axis=0)]}

    return _mapped(_met(anchors, blocks, threshold, sheet_blocks), work, "id bigint")


def near_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, sheet_blocks: int = SHEET_BLOCKS) -> DataFrame:
    """``a, b, similarity``: pairs of ids (a < b) of ``vectors(id, vector)`` whose cosine is at least ``threshold``, exactly.

    Vectors that are null, or hold a null, NaN or infinite component, are near nothing; a zero
    vector has cosine 0 with all. Vectors of different length raise ValueError.
    """
    unit = unit_vectors(vectors)
    return links(blocks_of(unit, pivots_of(unit), block_rows), threshold, None, sheet_blocks)
