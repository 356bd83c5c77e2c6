"""The index: chunks, sources and anchors in buckets of sources, changed by swapping a manifest.

``manifests/<n>.json`` lists, for each table and bucket, the folders of Parquet files that hold
it. Files are never changed: a change writes the buckets that it touches into a new folder, and then
the next manifest, which is the only step that readers see. What a change leaves behind
that breaks off before that is in no manifest, and ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import nearness
from tessera.schema import ANCHORS, INDEX, LEDGER
from tessera.session import write_table

#: Buckets of a new index, and folders from which on a bucket is written anew by the next change.
BUCKETS, MOST_FOLDERS = 64, 8
#: Bytes of a file that is small, and sources that are taken away at once.
SMALL_FILE, GONE_SOURCES = 8 * 1024 * 1024, 250_000
SCHEMAS = {"chunks": INDEX, "sources": LEDGER, "anchors": ANCHORS}


@dataclass(frozen=True)
class Snapshot:
    """One state of the index."""

    path: str
    version: int = 0
    buckets: int = BUCKETS
    folders: dict[str, dict[str, list[str]]] = field(default_factory=lambda: {name: {} for name in SCHEMAS})
    #: The last batch of each stream that the index has.
    batches: dict[str, int] = field(default_factory=dict)
    #: The vectors that the anchors' angles are to.
    pivots: list[list[float]] = field(default_factory=list)
    #: What the change to this state counted and took, as it ran.
    measured: dict[str, float] = field(default_factory=dict)

    def bucket(self, source: Column | str = "source") -> Column:
        return F.pmod(F.xxhash64(source), F.lit(self.buckets)).cast("long")

    def table(self, spark: SparkSession, name: str, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets; only their files are read."""
        paths = [f"{self.path}/{f}" for b, folders in self.folders[name].items() for f in folders if buckets is None or int(b) in buckets]
        return spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[name])

    def anchors(self, spark: SparkSession, buckets: set[int] | None = None) -> nearness.Blocks:
        """The stored blocks of vectors; blocks of several folders get numbers of their own."""
        held = self.table(spark, "anchors", buckets).withColumn("block", F.xxhash64("block", F.input_file_name()))
        return nearness.Blocks(held.select("block", "ids", "v", "low", "high"), np.array(self.pivots, np.float64) if self.pivots else np.zeros((0, 0)))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what makes paths of it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def names(spark: SparkSession, folder: str) -> list[str]:
    files, make = _files(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(make(folder))) if files.exists(make(folder)) else []


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The last state of the index at ``path``, or that of a version; none if there is no index."""
    found = [n for n in names(spark, f"{path}/manifests") if n.endswith(".json") and (version is None or int(n.split(".")[0]) == version)]
    if not found:
        return None
    return Snapshot(path, **json.loads(spark.read.text(f"{path}/manifests/{found[-1]}", wholetext=True).first()[0]))


def _swap(spark: SparkSession, after: Snapshot) -> None:
    """Make ``after`` the index's state; it has to be the first of its version."""
    publish(spark, after.path, after.version, json.dumps({k: getattr(after, k) for k in ("version", "buckets", "folders", "batches", "pivots", "measured")}))


def publish(spark: SparkSession, path: str, version: int, text: str) -> None:
    """Rename a manifest into place; fails if there is one of its version."""
    files, make = _files(spark, path)
    target, aside = make(f"{path}/manifests/{version:010d}.json"), make(f"{path}/manifests/.{uuid.uuid4().hex}")
    out = files.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark.sparkContext
    options = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = context._gateway.new_array(options, 1)
    how[0] = options.NONE  # fails if there is one
    context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, how)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """``version, files, unreadable, sources, chunks, kept, seconds`` of each batch that the index has, as they were measured in it."""
    kinds = "version bigint, files bigint, unreadable bigint, sources bigint, chunks bigint, kept bigint, seconds double"
    states = spark.read.schema(f"version bigint, measured struct<{kinds.split(', ', 1)[1]}>").json(f"{path}/manifests/*.json")
    return states.filter("measured.files is not null").select("version", "measured.*")


def create(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Snapshot:
    """The index at ``path``, made empty if there is none."""
    found = snapshot(spark, path)
    if found is None:
        _swap(spark, found := Snapshot(path, 0, buckets))
    return found


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the index as it is now; later changes don't bear on the frame."""
    return create(spark, path).table(spark, "chunks")


def _write(rows: DataFrame, schema: T.StructType, path: str, folder: str, gathered: bool = False) -> None:
    """Write rows with their ``bucket`` into a folder, beside what it has; ``gathered`` ones lie by bucket already."""
    typed = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema), "bucket")
    # else buckets are gathered, and large ones split, by size
    laid = typed if gathered else typed.hint("rebalance", F.col("bucket"))
    laid.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{folder}")


def _scattered(spark: SparkSession, before: Snapshot, name: str, buckets: set[int]) -> bool:
    """Whether these buckets of a table are many small files."""
    paths = [f"{before.path}/{f}" for b in buckets for f in before.folders[name].get(str(b), [])]
    files, make = _files(spark, before.path)
    held = [files.getContentSummary(make(p)) for p in paths]  # BUCKETS times MOST_FOLDERS at most
    many = sum(h.getFileCount() for h in held)
    return many >= MOST_FOLDERS * len(buckets) and sum(h.getLength() for h in held) < many * SMALL_FILE


def _without(spark: SparkSession, before: Snapshot, name: str, buckets: set[int], gone: DataFrame | None, many: int):
    """The rows of these buckets but those of the ``many`` sources ``gone(source, b)``, in frames of so few buckets that theirs go to the tasks."""
    if gone is None or not many:
        yield before.table(spark, name, buckets)
        return
    share = max(1, len(buckets) * GONE_SOURCES // many)
    for own in (sorted(buckets)[i : i + share] for i in range(0, len(buckets), share)):
        ours = gone.filter(F.col("b").isin(own)).select("source")
        # rows stay where they are, unless a bucket alone has too many
        yield before.table(spark, name, set(own)).join(F.broadcast(ours) if many <= len(buckets) * GONE_SOURCES else ours, "source", "left_anti")


def change(
    spark: SparkSession, before: Snapshot, added: dict[str, DataFrame] | None = None, gone: DataFrame | None = None, batch: tuple[str, int] | None = None,
    measured: Callable[[], dict[str, float]] | None = None, gathered: bool = False,
) -> Snapshot:
    """Add rows of ``chunks`` and ``sources``, and take away all rows of the sources ``gone(source)`` that were there before.

    The buckets of those sources are written anew without them, as are those of MOST_FOLDERS folders;
    rows for other buckets go into a folder beside theirs. Old rows are written by the tasks that read them, but go through a
    shuffle where they have come to be many small files; new chunks go through one unless they are ``gathered`` by bucket. ``batch`` is the stream and number of the
    batch that this change is, ``measured`` is called when all is written. The anchors are blocks of the chunks' vectors, made from what is
    written. Raises if somebody else has changed the index since ``before``.
    """
    named = None if gone is None else write_table(gone.select("source").distinct().withColumn("b", before.bucket()), "gone", compression="zstd")
    held_by = {} if named is None else dict(named.groupBy("b").count().collect())  # BUCKETS at most
    touched = set(held_by)
    touched |= {int(b) for held in before.folders.values() for b, folders in held.items() if len(folders) >= MOST_FOLDERS}
    folder, folders = f"data/{before.version + 1:010d}-{uuid.uuid4().hex}", {name: dict(held) for name, held in before.folders.items()}

    def put(name: str, rows: DataFrame, gathered: bool) -> None:
        _write(rows, SCHEMAS[name], before.path, f"{folder}/{name}", gathered)

    def register(name: str) -> None:
        folders[name] = {b: f for b, f in folders[name].items() if int(b) not in touched}
        for own in names(spark, f"{before.path}/{folder}/{name}"):
            if own.startswith("bucket="):
                b = own.removeprefix("bucket=")
                folders[name][b] = [*folders[name].get(b, []), f"{folder}/{name}/{own}"]

    for name in ("chunks", "sources"):
        parts = [] if added is None or name not in added else [(added[name], gathered and name == "chunks")]
        if touched:
            laid = not _scattered(spark, before, name, touched)
            parts += [(rows, laid) for rows in _without(spark, before, name, touched, named, sum(held_by.values()))]
        for rows, by_bucket in parts:
            put(name, rows.select(*SCHEMAS[name].names).withColumn("bucket", before.bucket()), by_bucket)
        if parts:
            register(name)
    pivots = before.pivots
    if names(spark, f"{before.path}/{folder}/chunks"):
        written = spark.read.schema(T.StructType([*INDEX.fields, T.StructField("bucket", T.LongType())])).parquet(f"{before.path}/{folder}/chunks")
        unit = nearness.comparable(written, "bucket")
        nearness.same_length(written.filter(nearness.whole(F.col("vector"))).select(F.size("vector").alias("size")))
        pivots = pivots or nearness.pivots_of(unit).tolist()
        put("anchors", nearness.laid(unit, np.array(pivots, np.float64) if pivots else np.zeros((0, 0)), keys=("bucket",)), True)
        register("anchors")
    after = replace(before, version=before.version + 1, folders=folders, pivots=pivots, batches=before.batches | (dict([batch]) if batch else {}), measured=measured() if measured else {})
    _swap(spark, after)
    return after


def append(spark: SparkSession, path: str, rows: DataFrame) -> Snapshot:
    """Add chunks."""
    return change(spark, create(spark, path), {"chunks": rows})


def remove_sources(spark: SparkSession, path: str, sources: DataFrame) -> Snapshot:
    """Delete the chunks of ``sources(source)``, and what is known of them; only their buckets are written anew."""
    return change(spark, create(spark, path), gone=sources)


def clear(spark: SparkSession, path: str) -> Snapshot:
    """Leave an empty index, without its batches' numbers."""
    before = create(spark, path)
    _swap(spark, after := Snapshot(path, before.version + 1, before.buckets))
    return after


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the manifests but the last ``keep``, and the folders that are in none of those; how many folders went.

    No change may be under way, and no reader of an older state.
    """
    numbers = [n for n in names(spark, f"{path}/manifests") if n.endswith(".json")]
    files, make = _files(spark, path)
    kept = [snapshot(spark, path, int(n.split(".")[0])) for n in numbers[-keep:]]
    used = {f.split("/")[1] for s in kept for held in s.folders.values() for folders in held.values() for f in folders}
    for n in numbers[:-keep]:
        files.delete(make(f"{path}/manifests/{n}"), False)
    unused = [n for n in names(spark, f"{path}/data") if n not in used]
    for n in unused:
        files.delete(make(f"{path}/data/{n}"), True)
    return len(unused)
