"""SimHash near-duplicates: fingerprints, tiled exact comparison, components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, join_by_key, lower_ascii, numbered, orderable, slices
from tessera.llm.components import connected_components
from tessera.session import write_table

#: Fingerprints are linked at this many differing bits or fewer.
RADIUS = 3
#: Bytes of a text whose words are listed at once.
PART_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Rows of a tile, and the rows of a block key above which its tile pairs become tasks of their own.
TILE, HEAVY = 512, 4096


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut at white space."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def fingerprint(text: bytes, words_per_shingle: int = 3, part_bytes: int = PART_BYTES) -> int:
    """SimHash of a lower-cased text: a bit is 1 if set in over half of the shingles' XXH64.

    The words are taken from one part of the text after the other, with the last ones of the
    part before, so memory is bounded for very long texts.
    """
    digest, ones, many = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for part in _parts(text, part_bytes):
        words = words[len(words) - min(len(words), words_per_shingle - 1) :] + part.split()
        if len(words) < words_per_shingle:
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts, stops = (ends - sizes)[: len(words) - words_per_shingle + 1], ends[words_per_shingle - 1 :]
        many += len(starts)
        for at in range(0, len(starts), 8192):
            spans = zip(starts[at : at + 8192].tolist(), stops[at : at + 8192].tolist(), strict=True)
            hashes = np.array([digest(joined[i:j], 42) for i, j in spans], dtype=">u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    if not many:  # fewer words than a shingle has: the whole sequence
        return digest(b" ".join(words), 42) if words else 0
    return int.from_bytes(np.packbits(2 * ones > many).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, fp`` per row; text_key (a hash of the text) tells apart rows with one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = lower_ascii(batch.column("text")).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(found)], names=["doc_id", "text_key", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.transform(bounded).mapInArrow(run, f"doc_id {kind}, text_key bigint, fp bigint")


def block_keys(blocks: int) -> list[tuple[int, ...]]:
    """Bit masks, so that two fingerprints within RADIUS agree wholly under one at least.

    The 64 bits are cut into ``blocks`` blocks; RADIUS differing bits touch RADIUS of them at
    most, so some choice of ``blocks - RADIUS`` blocks is untouched (pigeonhole).
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    return [tuple(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - RADIUS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def close_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within RADIUS, of two tiles that are sorted by population count.

    Each tile is compared with the whole other one by exclusive-or and bit counts, unless
    their population counts differ by more than RADIUS.
    """
    if not len(left) or not len(right):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = int(np.bitwise_count(left[0])), int(np.bitwise_count(left[-1]))
    other_low, other_high = int(np.bitwise_count(right[0])), int(np.bitwise_count(right[-1]))
    if low - other_high > RADIUS or other_low - high > RADIUS:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= RADIUS)


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least label over what the pairs (i, j) connect."""
    while True:
        least = np.minimum(labels[i], labels[j])
        after = labels.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        np.minimum.at(after, labels[i], least)
        np.minimum.at(after, labels[j], least)
        after = after[after]
        if np.array_equal(after, labels):
            return labels
        labels = after


def star_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within RADIUS in ``fps`` (sorted by population count).

    At most one link per fingerprint: a star per component, never all pairs.
    """
    labels = np.arange(len(fps))
    starts = range(0, len(fps), TILE)
    for a in starts:
        for b in range(a, len(fps), TILE):
            i, j = close_pairs(fps[a : a + TILE], fps[b : b + TILE])
            if len(i):
                labels = join_labels(labels, i + a, j + b)
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[moved], fps[labels[moved]]


def _links_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
    b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each run of equal ``mask, key``; rows come sorted, runs are at most HEAVY long."""
    rest: tuple[np.ndarray, ...] | None = None

    def links(mask: np.ndarray, key: np.ndarray, fps: np.ndarray, last: bool):
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        edges = np.concatenate([[0], cuts, [len(key)]])
        ends = len(edges) - 1 if last else len(edges) - 2
        sizes = np.diff(edges)[:ends]
        found = []
        pairs = np.flatnonzero(sizes == 2)  # most runs: compared all at once
        one, two = fps[edges[pairs]], fps[edges[pairs] + 1]
        near = np.bitwise_count(one ^ two) <= RADIUS
        found.append((two[near], one[near]))
        for r in np.flatnonzero(sizes > 2):
            a, b = star_links(fps[edges[r] : edges[r + 1]])
            if len(a):
                found.append((a, b))
        return _links_batch(found), edges[ends]

    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")]
        if rest is not None:
            now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        out, at = links(now[0], now[1], now[2].view(np.uint64), last=False)
        rest = tuple(x[at:] for x in now)
        yield out
    if rest is not None and len(rest[0]):
        yield links(rest[0], rest[1], rest[2].view(np.uint64), last=True)[0]


def _scan_tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the two tiles of each pair; rows come sorted by pair and side."""
    rest: list[np.ndarray] | None = None

    def links(pair: np.ndarray, side: np.ndarray, fps: np.ndarray, last: bool):
        edges = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])
        ends = len(edges) - 1 if last else len(edges) - 2
        found = []
        for r in range(ends):
            own, sides = fps[edges[r] : edges[r + 1]], side[edges[r] : edges[r + 1]]
            split = int(np.searchsorted(sides, 1))
            i, j = close_pairs(own[:split], own[split:])
            if len(i):
                labels = join_labels(np.arange(len(own)), i, j + split)
                moved = np.flatnonzero(labels != np.arange(len(own)))
                found.append((own[moved], own[labels[moved]]))
        return _links_batch(found), edges[ends]

    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "side", "fp")]
        if rest is not None:
            now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        out, at = links(now[0], now[1], now[2].view(np.uint64), last=False)
        rest = [x[at:] for x in now]
        yield out
    if rest is not None and len(rest[0]):
        yield links(rest[0], rest[1], rest[2].view(np.uint64), last=True)[0]


def near_links(nodes: DataFrame, blocks: int, heavy: int = HEAVY) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints ``nodes(fp)`` within RADIUS.

    Method note: which fingerprints meet at all is decided by block keys (pigeonhole, exact),
    since tiles over the whole corpus would be as many as its square. Within a key they are
    ordered by population count, cut into tiles of TILE, and tiles are compared as a whole by
    exclusive-or and bit counts unless their population counts are too far apart. Keys of
    two fingerprints are one comparison each. A key with more than ``heavy`` fingerprints is cut by population count and a salt into tiles of about
    TILE rows, and each pair of its tiles within RADIUS in population count is compared on
    its own, so no key is gathered in one task.
    """
    masks = [_signed(sum(parts)) for parts in block_keys(blocks)]
    keyed = nodes.select("fp", F.explode(F.array(*(F.lit(m) for m in masks))).alias("mask")).withColumn(
        "key", F.col("fp").bitwiseAND(F.col("mask"))
    )
    keyed = keyed.withColumn("pop", F.bit_count("fp"))
    counts = keyed.groupBy("mask", "key").agg(F.count("*").alias("rows"))
    hot = write_table(counts.filter(F.col("rows") > heavy), "hot-keys")
    if hot.isEmpty():
        light, links = keyed, None
    else:
        light = keyed.join(hot, ["mask", "key"], "left_anti")
        dense = keyed.join(hot.drop("rows"), ["mask", "key"])
        per_pop = dense.groupBy("mask", "key", "pop").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
        per_pop = write_table(per_pop, "hot-pops")
        tiled = dense.join(per_pop, ["mask", "key", "pop"]).withColumn(
            "salt", F.pmod(F.xxhash64("fp"), F.col("tiles"))
        )
        tiles = per_pop.select("mask", "key", "pop", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("salt"))
        one, two = tiles.alias("one"), tiles.alias("two")
        reach = tiles.select("mask", "key", "pop", "salt", F.explode(F.sequence(F.col("pop"), F.col("pop") + RADIUS)).alias("pop2"))
        pairs = reach.alias("one").join(
            two,
            (F.col("one.mask") == F.col("two.mask")) & (F.col("one.key") == F.col("two.key")) & (F.col("one.pop2") == F.col("two.pop"))
            & ((F.col("one.pop") < F.col("two.pop")) | (F.col("one.salt") <= F.col("two.salt"))),
        ).select(
            "one.mask", "one.key",
            F.col("one.pop").alias("pop1"), F.col("one.salt").alias("salt1"), F.col("two.pop").alias("pop2"), F.col("two.salt").alias("salt2"),
        )
        pairs = write_table(
            pairs.withColumn("pair", F.xxhash64("mask", "key", "pop1", "salt1", "pop2", "salt2")), "tile-pairs"
        )
        sides = pairs.select("mask", "key", F.col("pop1").alias("pop"), F.col("salt1").alias("salt"), "pair", F.lit(0).alias("side")).union(
            pairs.select("mask", "key", F.col("pop2").alias("pop"), F.col("salt2").alias("salt"), "pair", F.lit(1).alias("side"))
        )
        placed = tiled.select("mask", "key", "pop", "salt", "fp").join(sides, ["mask", "key", "pop", "salt"])
        links = (
            placed.select("pair", "side", "fp", "pop").repartition("pair").sortWithinPartitions("pair", "side", "pop")
            .transform(bounded).mapInArrow(_scan_tile_pairs, "a bigint, b bigint")
        )
    scanned = (
        light.repartition("mask", "key").sortWithinPartitions("mask", "key", "pop", "fp")
        .select("mask", "key", "fp").transform(bounded).mapInArrow(_scan_runs, "a bigint, b bigint")
    )
    return scanned if links is None else scanned.union(links)


def near_duplicates(docs: DataFrame, blocks: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, text_key, fp, component_id, root`` per row of ``docs``.

    ``root`` is the least fingerprint of the component, which names it. component_id is the least doc_id reachable over links of RADIUS or fewer differing bits,
    the row's own included. Exact copies share a fingerprint, so only distinct fingerprints
    are compared. ``blocks`` (4 by default, 5 or 6 for above 2**24 and 2**31 distinct
    fingerprints) only sets how the comparison is cut up; every choice is exact.

    Null and empty texts, and those with white space only, have fingerprint 0 and are linked
    like any other. Null ids take part; they are the least of a component only if it has no
    other id (then component_id is null). Repeated rows give repeated results. Columns other
    than doc_id and text are not read.
    """
    rows = write_table(fingerprints(docs), "fingerprints")
    nodes = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    if blocks is None:
        n = nodes.count()
        blocks = 4 if n <= 1 << 24 else 5 if n <= 1 << 31 else 6
    roots = connected_components(near_links(nodes.select("fp"), blocks, heavy))
    labelled = nodes.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = write_table(labelled.join(least, "root").select("fp", "component_id", "root", "rows"), "classes")
    return join_by_key(rows, classes, ["fp"], "rows").select("doc_id", "text_key", "fp", "component_id", "root")


def keep_one(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Of each component of near_duplicates the document with the least id (then text hash).

    Rows with the same id and text are one document; of them the least by all other columns
    stays (null first), in the order of the columns; those that Spark can't order, such as maps, go by their
    JSON. Rows that share an id, but are of
    different components, are different documents. Null and empty texts are near-duplicates of
    each other; a null id is the last choice; an empty table stays empty. Columns may have any
    name.
    """
    found = near_duplicates(docs, blocks)
    documents = found.groupBy("doc_id", "text_key", "root").agg(F.count("*").alias("rows"))
    best = documents.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "rows")).alias("b"))
    chosen = write_table(best.select(F.col("b.doc_id").alias("id"), F.col("b.text_key").alias("key"), F.col("b.rows").alias("rows")), "chosen")
    own, name = numbered(docs)
    kept = own.withColumn("text_key", F.xxhash64(name["text"])).join(chosen, F.col(name["doc_id"]).eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    rest = [n for c, n in name.items() if c not in ("doc_id", "text")]
    least = F.min_by(F.struct(*rest), F.struct(*(orderable(own.schema[n]) for n in rest))) if rest else F.count("*")
    several = kept.filter("rows > 1").groupBy(name["doc_id"], "key").agg(least.alias("r"), F.min(name["text"]).alias(name["text"]))
    single = kept.filter("rows = 1").select(*own.columns)
    return single.union(several.select(*(F.col("r")[n].alias(n) if n in rest else F.col(n) for n in own.columns))).toDF(*docs.columns)


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
