"""The prefix trie of rebuilt conversations, by vertical bitmaps of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded, join_by_key
from tessera.operators.order import numbered
from tessera.session import ship, write_table

#: Conversations of a shard (bits of a bitmap), and depths of a band.
SHARD, BAND = 256, 64
#: Most turns that a conversation takes from the first one of its hundred.
HEAD = 5
_MASK = (1 << 128) - 1


def _md5(*parts: Column) -> Column:
    """MD5 of some bytes in a row, as 16 bytes."""
    return F.unhex(F.md5(F.concat(*parts)))


def _lanes(key: Column) -> dict[str, Column]:
    """Four 32-bit parts of a 16-byte key, whose sums can't overflow."""
    return {f"s{i}": F.conv(F.hex(F.substring(key, 4 * i + 1, 4)), 16, 10).cast("long") for i in range(4)}


def _eight(number: Column) -> Column:
    """A number from 0 on as 8 bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_key, size`` per row: its place in its conversation from 1 on, a key of its role and text, and the text's code points.

    Turns come in order, null first, and rows of one turn in order of that key; null roles and
    texts are empty; rows without conv_id take no part. Places come from ranges of the whole
    order, so that a conversation of any length is spread over many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    seen = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _md5(F.unhex(F.md5(role.cast("binary"))), F.unhex(F.md5(text.cast("binary")))).alias("turn_key"),
        F.length(text).cast("long").alias("size"),
    )
    placed = write_table(numbered(seen, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_key"), name="place").drop("turn"), "turns-in-order")
    firsts = placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    joined = join_by_key(placed, write_table(firsts.withColumn("n", F.col("rows")), "first-places"), ["conv_id"], "n")
    return joined.select("conv_id", (F.col("place") - F.col("first") + 1).alias("pos"), "turn_key", "size", "rows")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: ``conv_id, depth, key, size`` per turn, and ``conv_id, turns`` per conversation.

    Conversation c has the first h turns of c - c % 100 and its own after its first h, with h as
    crc32 of its number modulo 6. ``key`` is of a turn at its depth.
    """
    turns = write_table(ordered_turns(conversations), "turns")
    counts = write_table(turns.filter("pos = 1").select("conv_id", "rows"), "conversations")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    with_base = counts.select("conv_id", "rows", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("rows").alias("base_rows"))
    took = F.least("h", F.coalesce("base_rows", F.lit(0))).alias("took")
    every = write_table(with_base.join(bases, "base", "left").select("conv_id", "rows", "base", "h", took), "rebuilt-conversations")

    # a conversation of h rows at most has none left, so those of others are far from all rows of a key
    own = join_by_key(turns.drop("rows"), every.select("conv_id", "h", "took", F.col("rows").alias("n")), ["conv_id"], "n")
    own = own.filter(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("took")).alias("depth"), "turn_key", "size")
    heads = turns.filter(F.col("pos") <= HEAD).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "turn_key", "size")
    taken = every.filter("took > 0").select("conv_id", "base", "took").join(heads, "base").filter(F.col("depth") <= F.col("took")).select("conv_id", "depth", "turn_key", "size")
    keyed = own.union(taken).select("conv_id", "depth", _md5(_eight(F.col("depth")), F.col("turn_key")).alias("key"), "size")
    return keyed, every.select("conv_id", (F.col("took") + F.greatest(F.col("rows") - F.col("h"), F.lit(0))).alias("turns"))


def _places(bitmap: int) -> list[int]:
    """The places of the bits that are set, in order."""
    out = []
    while bitmap:
        low = bitmap & -bitmap
        out.append(low.bit_length() - 1)
        bitmap ^= low
    return out


def shard_nodes(shard: int, band: int, table: pa.Table, sizes: tuple[int, int]) -> pa.Table:
    """The nodes of a shard's conversations within a band of depths; ``sizes`` are SHARD and BAND.

    Postings map each turn at its depth to the bitmap of the shard's conversations that have
    it. From the bitmaps of the band's first nodes on, the lowest conversation that is left
    names the next turn, and the intersection with its posting is the child; its popcount is
    its members, and what has no turn left is its end list. A node's place is the sum of the
    keys on the way to it, the same in all shards.
    """
    column = {c: table.column(c).to_pylist() for c in ("at", "conv_id", "depth", "key", "size", "turns", "prefix")}
    ids: dict[int, int] = {}
    posting: dict[bytes, int] = {}  # conversations by turn at its depth
    ending: dict[int, int] = {}  # conversations by their number of turns
    turn: dict[tuple[int, int], tuple[bytes, int]] = {}
    roots: dict[int, int] = {}
    for at, conv, depth, own, size, turns, prefix in zip(*column.values(), strict=True):
        if own is None:  # once for each conversation and band: where it comes in
            ids[at] = conv
            ending[turns] = ending.get(turns, 0) | 1 << at
            place = _sum_of(prefix)
            roots[place] = roots.get(place, 0) | 1 << at
        else:
            turn[at, depth] = own, size
            posting[own] = posting.get(own, 0) | 1 << at
    out: dict[str, list] = {c: [] for c in ("node", "parent", "depth", "size", "conv_id", "members", "n_ends", "ends", "bitmap")}
    width, first, last = sizes[0] // 8, band * sizes[1], (band + 1) * sizes[1]

    def emit(node: int, parent: int | None, depth: int, size: int, bitmap: int) -> int:
        """Writes the node; what goes on below it. Places in a shard are in order of conv_id."""
        ended = bitmap & ending.get(depth, 0)
        ends = np.array([ids[i] for i in _places(ended)], "<i8")
        smallest = ids[(bitmap & -bitmap).bit_length() - 1]
        values = node.to_bytes(16), None if parent is None else parent.to_bytes(16), depth, size, smallest, bitmap.bit_count(), len(ends), ends.tobytes(), bitmap.to_bytes(width, "little")
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
        return bitmap ^ ended

    todo: list[tuple[int, int, int]] = []
    for node, bitmap in roots.items():
        todo.append((node, first, emit(node, None, 0, 0, bitmap) if band == 0 else bitmap))
    while todo:
        node, depth, left = todo.pop()
        if depth == last:
            continue
        while left:
            lowest = (left & -left).bit_length() - 1
            own, size = turn[lowest, depth + 1]
            child = left & posting[own]
            left ^= child
            place = (node + int.from_bytes(own)) & _MASK
            todo.append((place, depth + 1, emit(place, node, depth + 1, size, child)))
    n = len(out["node"])
    kinds = {"node": pa.binary(), "parent": pa.binary(), "ends": pa.binary(), "bitmap": pa.binary()}
    return pa.table({"shard": pa.array([shard] * n, pa.int64()), "band": pa.array([band] * n, pa.int64()), **{c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()}})


def _sum_of(prefix: bytes | None) -> int:
    """The place that four lane sums stand for."""
    if prefix is None:
        return 0
    lanes = [int.from_bytes(prefix[8 * i : 8 * i + 8]) for i in range(4)]
    return sum(x << 32 * (3 - i) for i, x in enumerate(lanes)) & _MASK


def _member_sums(nodes: pa.Table, members: pa.Table, size: int) -> pa.Table:
    """Per node of a shard and band the sums of ``leaf`` and ``weight`` over the members in its bitmap."""
    values = np.zeros((size, 2), np.int64)
    values[members.column("at").to_numpy()] = np.stack([members.column("leaf").to_numpy(), members.column("weight").to_numpy()], axis=1)
    raw = np.frombuffer(b"".join(nodes.column("bitmap").to_pylist()), np.uint8).reshape(-1, size // 8)
    sums = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64) @ values if len(raw) else np.zeros((0, 2), np.int64)
    return pa.table({"node": nodes.column("node").cast(pa.binary()), "leaves": pa.array(sums[:, 0]), "saved": pa.array(sums[:, 1])})


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ends, which come in order of node and shard; no list is held whole."""
    now, digest = None, None
    for batch in batches:
        nodes, digests = [], []
        for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            more = ",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode()
            if node == now:
                digest.update(b"," + more)
                continue
            if now is not None:
                nodes.append(now)
                digests.append(digest.hexdigest())
            now, digest = node, hashlib.sha256(more)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def _before(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``rows`` with the sums of ``values`` over a key's earlier bands, as ``before_<value>``; a row a key and band."""
    earlier = Window.partitionBy(key).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"before_{v}") for v in values))


def banded(turns: DataFrame, shards: DataFrame) -> DataFrame:
    """The rows that a shard's bands get: each turn, and where each conversation comes into a band.

    The place at which a conversation enters a later band is the sum of its keys up to there,
    which takes a row a band and not its turns.
    """
    band = F.floor((F.col("depth") - 1) / BAND).cast("long").alias("band")
    parts = turns.withColumn("band", band)
    own = write_table(parts.groupBy("conv_id", "band").agg(*(F.sum(x).alias(name) for name, x in _lanes(F.col("key")).items())), "bands")
    prefixes = _before(own, "conv_id", [f"s{i}" for i in range(4)]).filter("band > 0").select("conv_id", "band", F.concat(*(_eight(F.col(f"before_s{i}")) for i in range(4))).alias("prefix"))
    none = F.lit(None)
    first = shards.select("shard", "at", "conv_id", F.lit(0).cast("long").alias("band"), F.lit(0).cast("long").alias("depth"), none.cast("binary").alias("key"), none.cast("long").alias("size"), "turns", none.cast("binary").alias("prefix"))
    later = prefixes.join(shards, "conv_id").select("shard", "at", "conv_id", "band", (F.col("band") * BAND).alias("depth"), none.cast("binary").alias("key"), none.cast("long").alias("size"), "turns", "prefix")
    placed = join_by_key(parts, shards.withColumn("n", F.col("turns")), ["conv_id"], "n")
    inner = placed.select("shard", "at", "conv_id", "band", "depth", "key", "size", "turns", none.cast("binary").alias("prefix"))
    return first.unionByName(later).unionByName(inner)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations, one row each.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. SHARD conversations in order of id make a shard, and BAND
    depths a band, so that no group grows with the table, with a common turn, or with a
    long conversation. Each shard's bitmaps give its own nodes; equal nodes of several shards
    are added up by partial aggregates.

    A subtree's sums need no walk up the trie. Each node counts for its smallest member,
    whose nodes are a chain that ends in its last turn; what a node's subtree holds is then
    the sum over its members, which the bitmaps give, without the part of its own smallest
    member's chain above it.

    Nulls in role and text are empty strings, null turns come first, rows of one turn are
    ordered by role and text, repeated rows are turns of their own, rows without conv_id take
    no part, other columns aren't read, and an empty table has no nodes. Texts of any length
    enter as keys of 128 bits.
    """
    ship(conversations.sparkSession)
    turns, lengths = rebuilt(conversations)
    turns = write_table(turns, "rebuilt-turns")
    place = F.col("position") - 1
    shards = write_table(
        numbered(lengths, F.col("conv_id")).select("conv_id", "turns", F.floor(place / SHARD).cast("long").alias("shard"), (place % SHARD).alias("at")), "shards"
    )
    sizes = SHARD, BAND

    def nodes_of(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return shard_nodes(key[0].as_py(), key[1].as_py(), table, sizes)

    def sums_of(key: tuple[pa.Scalar, ...], table: pa.Table, own: pa.Table) -> pa.Table:
        return _member_sums(table, own, sizes[0])

    schema = "shard bigint, band bigint, node binary, parent binary, depth bigint, size bigint, conv_id bigint, members bigint, n_ends bigint, ends binary, bitmap binary"
    found = write_table(banded(turns, shards).groupBy("shard", "band").applyInArrow(nodes_of, schema), "shard-nodes")
    total = [F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.sum("n_ends").alias("n_ends")]
    nodes = write_table(found.groupBy("node").agg(*total), "nodes")

    weight = (F.col("n_convs") - 1) * F.col("size")
    chains = nodes.groupBy("conv_id").agg(F.sum(weight).alias("weight"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"))
    bands = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("turns", F.lit(1)) - 1) / BAND).cast("long"))).alias("band")
    members = shards.join(chains, "conv_id").select("shard", "at", "weight", "leaf", bands)
    summed = found.select("shard", "band", "node", "bitmap").groupBy("shard", "band").cogroup(members.groupBy("shard", "band"))
    sums = summed.applyInArrow(sums_of, "node binary, leaves bigint, saved bigint")

    # of the chain of the node's smallest member, what lies above the node: in earlier bands, and within its own
    shared = nodes.filter("n_convs > 1").select("node", "conv_id", "depth", weight.alias("weight"), F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / BAND).cast("long").alias("band"))
    by_band = _before(shared.groupBy("conv_id", "band").agg(F.sum("weight").alias("weight")), "conv_id", ["weight"]).select("conv_id", "band", "before_weight")
    within = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = shared.withColumn("within", F.coalesce(F.sum("weight").over(within), F.lit(0))).join(by_band, ["conv_id", "band"])

    ended = found.filter("n_ends > 0").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard").select("node", "ends")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    facts = (
        sums.select("node", "leaves", "saved", zero.alias("children"), none.alias("digest"))
        .union(above.select("node", zero, -(F.col("within") + F.col("before_weight")), zero, none))
        .union(nodes.filter("parent is not null").select("parent", zero, zero, F.lit(1).cast("long"), none))
        .union(ended.transform(bounded).mapInArrow(_end_digests, "node binary, ends_sha256 string").select("node", zero, zero, zero, "ends_sha256"))
    )
    added = facts.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("n_children"), F.max("digest").alias("digest"))
    whole = write_table(nodes.join(added, "node"), "trie-nodes")
    parents = whole.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = join_by_key(whole.filter("parent is not null"), parents, ["parent"], "n")
    root = whole.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    # the subtree of a node with one member is a chain of such, in which nothing is saved
    saved = F.when(F.col("n_convs") > 1, F.col("saved")).otherwise(F.lit(0)).alias("saved_tokens")
    digest = F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return below.unionByName(root).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, digest)


ORACLE = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, t, n_points, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS p
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n_points, md5(unhex(md5(coalesce(role, ''))) || unhex(md5(coalesce(text, '')))) AS t
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, count(*) AS n, c - c % 100 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM turns GROUP BY c),
taking AS (SELECT v.c, v.n, v.base, v.h, least(v.h, coalesce(b.n, 0)) AS took FROM convs v LEFT JOIN convs b ON b.c = v.base),
built AS (
  SELECT k.c, t.p - k.h + k.took AS d, t.t, t.n_points FROM taking k JOIN turns t ON t.c = k.c AND t.p > k.h
  UNION ALL SELECT k.c, t.p, t.t, t.n_points FROM taking k JOIN turns t ON t.c = k.base AND t.p <= k.took),
members AS (
  SELECT c, 0 AS d, '' AS node, 0 AS n_points FROM convs
  UNION ALL SELECT c, d, md5(array_to_string(list(t) OVER (PARTITION BY c ORDER BY d), ',')), n_points FROM built),
lengths AS (SELECT c, max(d) AS turns FROM members GROUP BY c),
nodes AS (
  SELECT m.node, m.d, min(m.c) AS c, count(*) AS n, max(m.n_points) AS n_points, count(*) FILTER (l.turns = m.d) AS n_ends,
    coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (l.turns = m.d), '') AS ends
  FROM members m JOIN lengths l ON l.c = m.c GROUP BY m.node, m.d),
links AS (SELECT DISTINCT child.node, up.node AS parent FROM members child JOIN members up ON up.c = child.c AND up.d = child.d - 1),
below AS (SELECT DISTINCT v.node, u.node AS under FROM members v JOIN members u ON u.c = v.c AND u.d >= v.d),
subtrees AS (
  SELECT b.node, count(*) FILTER (u.n_ends = u.n) AS n_leaves, sum((u.n - 1) * u.n_points)::BIGINT AS saved_tokens
  FROM below b JOIN nodes u ON u.node = b.under GROUP BY b.node)
SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, (SELECT count(*) FROM links x WHERE x.parent = n.node) AS n_children,
  s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN subtrees s ON s.node = n.node LEFT JOIN links l ON l.node = n.node LEFT JOIN nodes up ON up.node = l.parent
"""
