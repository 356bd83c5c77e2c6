"""Benchmark decontamination: size-partitioned MinHash containment search, natively."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered
from tessera.session import write_table

#: Words of a shingle, and the share of an item's shingles that a document must contain.
WORDS, CONTAINMENT = 5, 0.8
#: Binary logarithm of the most bits of the map of sketch values (4 MB).
MAP_BITS = 25
#: Lists that a document's candidates are dealt into: so many copies of its shingles are made at most.
LISTS = 64


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs_of(words: Column, width: Column | int, each: Callable[[Column], Column] = lambda s: s, kind: str = "string") -> Column:
    """``each`` of every run of ``width`` words, space-joined; none if there are fewer words."""
    width = F.lit(width) if isinstance(width, int) else width
    own = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: each(F.array_join(F.slice(words, i, width), " ")))
    return F.when((F.size(words) >= width) & (width > 0), own).otherwise(F.array().cast(f"array<{kind}>"))


def shingles_of(text: Column, widths: list[int], each: Callable[[Column], Column] = lambda s: s, kind: str = "string") -> Column:
    """``each`` of every run of as many words as one of ``widths``, in one list."""
    lists = lambda words: F.concat(F.array().cast(f"array<{kind}>"), *(runs_of(words, w, each, kind) for w in widths))
    return bound(words_of(text), lists)


def sketch_items(items: DataFrame, width: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """``item_id, width, shingles, n, part, sketch`` per item: its size partition and MinHash sketch.

    Shingles have ``width`` words, or all words of a shorter item. Partition p holds the items
    of 2**p to 2**(p+1) - 1 distinct shingles. A document that contains the share
    ``containment`` of an item misses n - ceil(containment * n) of its shingles at most, so of
    any one more it has one: the sketch is the so many least hash values (bottom-k MinHash),
    and a search by them misses nothing.
    """
    own = F.least(F.size("words"), F.lit(width))
    sized = (
        items.select("item_id", words_of(F.col("text")).alias("words")).withColumn("width", own)
        .select("item_id", "width", F.array_sort(F.array_distinct(runs_of(F.col("words"), F.col("width")))).alias("shingles"))
        .distinct()
        .withColumn("n", F.size("shingles"))
        .filter("n > 0")
    )
    k = F.col("n") - F.ceil(containment * F.col("n") - 1e-9) + 1
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s)))
    return sized.withColumn("part", F.floor(F.log2("n")).cast("int")).withColumn("sketch", F.slice(hashes, F.lit(1), k.cast("int")))


def value_bits(sketch: DataFrame) -> tuple[DataFrame, int]:
    """One row with a bit map (an array of longs) of the sketch values' lowest bits, and the number of bits.

    About sixteen places a value, MAP_BITS at most, so its size is bounded whatever the items.
    """
    bits = 1 << min(MAP_BITS, max(10, math.ceil(math.log2(16 * max(sketch.count(), 1)))))
    cell = F.shiftrightunsigned(F.col("value").bitwiseAND(F.lit(bits - 1)), 6)
    set_bits = sketch.groupBy(cell.alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(value & 63 as int))")).alias("w"))
    every = sketch.sparkSession.range(bits >> 6).withColumnRenamed("id", "cell").join(set_bits, "cell", "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cell", F.coalesce("w", F.lit(0)).alias("w")))), lambda c: c["w"])
    return write_table(every.agg(listed.alias("bits")), "sketch-bits"), bits


def contained_items(
    docs: DataFrame, items: DataFrame, width: int = WORDS, containment: float = CONTAINMENT
) -> DataFrame:
    """``doc_id, text_key, item_id, shared, n_shingles``: each item that a document contains.

    A document gives the shingles of every width that occurs among the items (``width`` of
    them at most). Of their hashes those stay that are below the largest sketch value of the
    size partitions that the document reaches, and are in the bit map of the sketch values;
    so what is exploded is little more than what a sketch has. It meets the sketches in an
    equi-join (broadcast by the planner only where the written sketch table is small). Each
    candidate is then verified on the shingles themselves: at least ``containment`` of the
    item's distinct shingles are in the document. A document's candidates are dealt into LISTS
    lists by hash, so one that holds very many items isn't copied for each of them.

    An item of fewer than ``width`` words is one shingle of all its words, found wherever a
    document has just those words in a row. Null or wordless texts contain nothing and are
    contained in nothing. Rows that repeat an item_id are items of their own, reported by the
    best one; rows that repeat a document give one result. Very long texts are a row like any
    other; either table may be empty; other columns aren't read.
    """
    sketched = write_table(sketch_items(items, width, containment), "items")
    # one row for each width and power of two of the items' sizes: 5 * 31 at most
    parts = sketched.groupBy("width", "part").agg(F.max(F.element_at("sketch", -1)).alias("cut"), F.min("n").alias("least")).collect()
    widths = sorted({p["width"] for p in parts})
    sketch = write_table(sketched.select("item_id", F.explode("sketch").alias("value")).distinct(), "sketch")
    keyed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    bit_map, bits = value_bits(sketch)
    hashes = keyed.select("doc_id", "text_key", shingles_of(F.col("text"), widths, F.xxhash64, "bigint").alias("h"))
    cuts = [F.when(F.size("h") >= math.ceil(containment * p["least"] - 1e-9), F.lit(p["cut"])) for p in parts]
    cut = F.greatest(*cuts) if len(cuts) > 1 else cuts[0] if cuts else F.lit(None).cast("bigint")
    mapped = f"bit_get(get(bits, cast((x & {bits - 1}L) >>> 6 as int)), cast(x & 63 as int)) = 1"
    with_map = hashes.join(F.broadcast(bit_map), how="cross")  # one row of at most 2**MAP_BITS bits
    pruned = with_map.withColumn("cut", cut).select(
        "doc_id", "text_key", F.explode(F.expr(f"filter(h, x -> x <= cut and {mapped})")).alias("value")
    )
    candidates = write_table(pruned.join(sketch, "value").select("doc_id", "text_key", "item_id").distinct(), "candidates")

    wanted = candidates.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("item_id").alias("item"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    texts = keyed.join(wanted.select("id", "key").distinct(), same, "left_semi")
    full = texts.select("doc_id", "text_key", F.array_distinct(shingles_of(F.col("text"), widths)).alias("own"))
    listed = (
        wanted.join(sketched.select("item_id", "shingles", "n"), F.col("item").eqNullSafe(F.col("item_id")))
        .groupBy("id", "key", F.pmod(F.xxhash64("item"), F.lit(LISTS)).alias("list"))
        .agg(F.collect_list(F.struct("item_id", "shingles", "n")).alias("items"))
    )
    # a document's shingles are searched once a list; each of its items then meets what was found
    hits = F.array_intersect(F.flatten("items.shingles"), "own")
    shared = lambda hit: F.transform(
        "items", lambda i: F.struct(i["item_id"].alias("item_id"), i["n"].alias("n"), F.size(F.array_intersect(i["shingles"], hit)).cast("long").alias("shared"))
    )
    verified = (
        full.join(listed, same).select("doc_id", "text_key", F.inline(bound(hits, shared)))
        .filter(F.col("shared") >= F.ceil(containment * F.col("n") - 1e-9))
    )
    best = F.max(F.struct(F.col("shared") / F.col("n"), F.col("shared").alias("s"), F.col("n").cast("long").alias("n")))
    return (
        verified.groupBy("doc_id", "text_key", "item_id").agg(best.alias("best"))
        .select("doc_id", "text_key", "item_id", F.col("best.s").alias("shared"), F.col("best.n").alias("n_shingles"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without those that contain an item, with their own columns (whatever their names) and repeats."""
    bad = contained_items(docs, items, width, containment).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    bad = write_table(bad.distinct(), "contaminated")
    own, name = numbered(docs)
    matched = F.col(name["doc_id"]).eqNullSafe(F.col("id")) & F.xxhash64(name["text"]).eqNullSafe(F.col("key"))
    return own.join(bad, matched, "left_anti").toDF(*docs.columns)


def report(found: DataFrame) -> DataFrame:
    """Per document id and item the best containment."""
    best = F.max(F.struct(F.col("shared") / F.col("n_shingles"), "shared", "n_shingles")).alias("b")
    return (
        found.groupBy("doc_id", "item_id").agg(best)
        .select("doc_id", "item_id", "b.shared", "b.n_shingles", (F.col("b.shared") / F.col("b.n_shingles")).alias("containment"))
    )


ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
widths AS (SELECT DISTINCT least(len(w), 5)::BIGINT AS k FROM item_words WHERE len(w) > 0),
doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS s
  FROM doc_words, widths WHERE len(w) >= k),
item_shingles AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' '))) AS s
  FROM item_words WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*)::BIGINT AS n_shingles FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS shared, n_shingles, count(*)::DOUBLE / n_shingles AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= ceil(0.8::DOUBLE * n_shingles - 1e-9)
"""
