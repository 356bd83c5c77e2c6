"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ship

#: Text bytes that go to Python in one batch, and that a task handles at once (one row at least).
SLICE_BYTES = 8 * 1024 * 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose batches to Python are bounded in bytes, so that long texts don't add up in a task.

    The bound is a setting of the session, which ``build_session`` makes. In a session without
    it, it is lowered to SLICE_BYTES here (never raised) and stays so, since frames run later.
    """
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(key))
    if not now or not 0 < int(now[1]) <= SLICE_BYTES:
        conf.set(key, str(SLICE_BYTES))
    return df


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called c0, c1, ..., and the new name of each.

    Operators that hand on a table's own columns work on such names, so none of theirs can
    clash with the table's; ``toDF(*df.columns)`` gives the names back.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def orderable(field: T.StructField) -> Column:
    """The column of ``field``, or its JSON where Spark has no order for it (maps, and what holds them)."""

    def ordered(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return ordered(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(ordered(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))

    return F.col(field.name) if ordered(field.dataType) else F.to_json(F.struct(field.name))


#: Rows from which on a key counts as hot.
HOT_ROWS = 1000


def join_by_key(rows: DataFrame, per_key: DataFrame, key: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``per_key`` (one row a key) without gathering a hot key's rows in a task.

    ``count`` of ``per_key`` is the number of a key's rows. Keys above a 4096th of all rows
    (and HOT_ROWS) are less than 4096 by that, so they are broadcast; the rest are joined as
    the planner likes.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = per_key.filter(F.col(count) > max(HOT_ROWS, total // 4096))
    if hot.isEmpty():
        return rows.join(per_key.drop(count), key)
    cool = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(per_key.drop(count), key)
    return cool.unionByName(rows.join(F.broadcast(hot.drop(count)), key))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased, all else as it is; null becomes empty."""
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words.filter(full), kept[offsets]


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """As split_words, with the words as codes into an array of the distinct ones."""
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, offsets


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i, along the first axis."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def gathered(pool: np.ndarray, begins: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[begins[i] : begins[i] + lengths[i]] for i in ``order`` in a row, and their edges."""
    own = lengths[order]
    edges = np.concatenate([[0], np.cumsum(own)])
    small = np.int32 if max(int(edges[-1]), len(pool)) < 1 << 31 else np.int64
    at = np.repeat((begins[order] - edges[:-1]).astype(small), own)
    at += np.arange(int(edges[-1]), dtype=small)
    return pool[at], edges
