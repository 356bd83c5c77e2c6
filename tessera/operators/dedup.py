"""Duplicates among chunks, and change detection between index runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_hash
from tessera.operators import nearness
from tessera.operators.components import connected_components
from tessera.operators.nearness import Blocks, near_pairs, normalised
from tessera.session import ship, write_table

__all__ = ["near_pairs", "normalised"]

#: Links that a task walks at once, that a pair of blocks may write, and rounds that settle crowds without links.
HELD_LINKS, BLOCK_LINKS, ROUNDS = 2_000_000, 16_384, 8


def first_by_content(chunks: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each text, with its ``chunk_hash``.

    The least place per hash is a partial aggregate, so even a text that a third of all rows
    share goes to the shuffle once per task. Null texts are one text.
    """
    place = F.struct(*order)
    hashed = chunks.withColumn("chunk_hash", F.coalesce(content_hash(F.col(text)), F.lit("")))
    rest = [c for c in hashed.columns if c not in (*order, "chunk_hash")]
    kept = hashed.groupBy("chunk_hash").agg(F.min_by(F.struct(*hashed.columns), place).alias("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in [*order, *rest]), "chunk_hash")


def _walked(key: tuple[pa.Scalar, ...], edges: pa.Table) -> pa.Table:
    """Ids that a pass in id order drops, of links (a, b); a link without a drops b from the start."""
    gone = set(edges.filter(pc.is_null(edges.column("a"))).column("b").to_pylist())
    links = edges.filter(pc.is_valid(edges.column("a"))).sort_by([("b", "ascending"), ("a", "ascending")])
    for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist(), strict=True):
        if a not in gone:
            gone.add(b)
    return pa.table({"id": pa.array(sorted(gone), pa.int64())})


def greedy_kept(ids: DataFrame, pairs: DataFrame, held: int = HELD_LINKS) -> DataFrame:
    """Ids that a pass in id order keeps: those with no kept id before them among their pairs.

    Components of the pairs don't bear on each other, so they are walked side by side, many to a
    task and about ``held`` links in each. A component of more links is walked range by range
    of ids: what the kept ids of earlier ranges drop is known by then, and a range's own links
    are few enough for a task. However long its chains are, that ends after links / ``held`` steps.
    """
    ship(ids.sparkSession)
    edges = write_table(pairs.select("a", "b"), "pairs")
    total = edges.count()
    if total == 0:
        return ids
    if total <= held:
        dropped = write_table(edges.groupBy(F.lit(0).alias("g")).applyInArrow(_walked, "id bigint"), "dropped")
        return ids.join(dropped, "id", "left_anti")
    rooted = write_table(edges.join(connected_components(edges), "a"), "rooted")
    large = write_table(rooted.groupBy("root").agg(F.count("*").alias("links")).filter(F.col("links") > held), "large")
    small = rooted.join(large, "root", "left_anti").withColumn("g", F.pmod(F.xxhash64("root"), F.lit(-(-total // held))))
    dropped = write_table(small.select("a", "b", "g").groupBy("g").applyInArrow(_walked, "id bigint"), "dropped")
    if not large.isEmpty():
        rest = write_table(rooted.join(large, "root", "left_semi").select("a", "b"), "large-links")
        steps = -(-2 * rest.count() // held)
        shares = [(i + 1) / steps for i in range(steps)]
        bounds = sorted(set(rest.agg(F.percentile_approx("b", shares, 10 * steps)).first()[0]))  # a number a step
        low = None
        for high in bounds:
            own = rest.filter(F.col("b") <= high) if low is None else rest.filter((F.col("b") <= high) & (F.col("b") > low))
            within = own if low is None else own.filter(F.col("a") > low)
            if low is not None:
                earlier = own.filter(F.col("a") <= low).join(dropped.withColumnRenamed("id", "a"), "a", "left_anti")
                within = within.union(earlier.select(F.lit(None).cast("long").alias("a"), "b").distinct())
            gone = within.groupBy(F.lit(0).alias("g")).applyInArrow(_walked, "id bigint")
            dropped, low = write_table(dropped.union(gone), "dropped"), high
    return ids.join(dropped, "id", "left_anti")


def _settled(unit: DataFrame, pivots: np.ndarray, threshold: float, most: int, rounds: int) -> DataFrame:
    """Ids of ``unit(id, v)`` that a pass in id order keeps.

    Links are written for the pairs of blocks that have ``most`` of them at most. Where others have
    more, a round settles what is sure without links: rows that are near no earlier one stay,
    and what is near those goes, which takes a crowd of copies away at once. After
    ``rounds`` of that all links are written.
    """
    kept = None
    for left in range(rounds, -1, -1):
        found = write_table(nearness.links(nearness.blocks_of(unit, pivots), threshold, most if left else None), "links")
        if found.filter("a is null").isEmpty():
            break
        firsts = write_table(unit.join(found.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "firsts")
        kept = firsts.select("id") if kept is None else kept.union(firsts.select("id"))
        near = nearness.near_any(nearness.blocks_of(unit, pivots), nearness.blocks_of(firsts, pivots), threshold)
        unit = write_table(unit.join(near.union(firsts.select("id")).distinct(), "id", "left_anti"), "unsettled")
    own = greedy_kept(unit.select("id"), found.select("a", "b"))
    return own if kept is None else own.union(kept)


def first_by_similarity(
    vectors: DataFrame, threshold: float = 0.95, anchors: DataFrame | Blocks | None = None, most: int = BLOCK_LINKS, rounds: int = ROUNDS
) -> DataFrame:
    """Rows of ``vectors(id, vector)`` that a greedy pass in id order keeps, at length one.

    A row goes if one that is kept is at least ``threshold`` similar; a row similar only
    to dropped rows stays. ``anchors``, rows or stored blocks of them, were kept before: they come first, whatever
    their ids, and aren't compared with each other. Vectors that are null, or hold a null,
    NaN or infinite component, are like nothing and stay, as does a zero vector with a threshold above
    0. Vectors of different length raise ValueError.
    """
    # copies of a vector share its fate but for the first, so only that one is compared
    unlike = vectors.filter(nearness.whole(F.col("vector"))).groupBy("vector").agg(F.min("id").alias("id"))
    unit = nearness.unit_vectors(unlike)
    if isinstance(anchors, DataFrame):
        before = nearness.unit_vectors(anchors.select("id", "vector"))
        anchors = nearness.blocks_of(before, nearness.pivots_of(before))
    if anchors is not None:
        near = nearness.near_any(nearness.blocks_of(unit, anchors.pivots), anchors, threshold)
        unit = write_table(unit.join(near.distinct(), "id", "left_anti"), "unlike-anchors")
    pivots = nearness.pivots_of(unit) if anchors is None or not len(anchors.pivots) else anchors.pivots
    kept = _settled(unit, pivots, threshold, most, rounds)
    odd = vectors.filter(~nearness.whole(F.col("vector"))).withColumn("vector", F.col("vector").cast("array<double>"))
    return vectors.join(kept, "id", "left_semi").withColumn("vector", normalised(F.col("vector"))).unionByName(odd)


def indexed_sources(index: DataFrame) -> DataFrame:
    """Per source of the index: chunks, and the hash and times of its first chunk."""
    first = F.min_by(F.struct("timestamp", "file_hash", "file_modified"), F.struct("timestamp", "chunk_index"))
    return index.groupBy("source").agg(F.count("*").alias("chunks"), first.alias("f")).select("source", "chunks", "f.timestamp", "f.file_hash", "f.file_modified")


def needs_reindexing(new_hash: Column, old_hash: Column, new_time: Column, old_time: Column) -> Column:
    """Unreadable files (no hash) stay; a different hash decides; times only where there is no old hash."""
    return F.when(new_hash.isNull(), False).when(old_hash.isNotNull(), new_hash != old_hash).otherwise(F.coalesce(new_time > old_time, F.lit(True)))


def change_status(manifest: DataFrame, indexed: DataFrame, *kept: str) -> DataFrame:
    """``source, status`` of ``manifest(source, file_hash, file_modified)``: new, changed, unchanged or unreadable; and its ``kept`` columns."""
    old = indexed.select("source", F.col("file_hash").alias("_hash"), F.col("file_modified").alias("_time"), F.lit(True).alias("_there"))
    joined = manifest.join(old, "source", "left")
    changed = needs_reindexing(F.col("file_hash"), F.col("_hash"), F.col("file_modified"), F.col("_time"))
    status = F.when(F.col("file_hash").isNull(), "unreadable").when(F.col("_there").isNull(), "new").when(changed, "changed").otherwise("unchanged")
    return joined.select("source", status.alias("status"), *kept)


def without_sources(index: DataFrame, sources: DataFrame) -> DataFrame:
    """The index without the chunks of these sources."""
    return index.join(sources.select("source").distinct(), "source", "left_anti")
