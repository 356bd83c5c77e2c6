"""Mixing sources to target weights: repetition rates and seeded copies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import numbered
from tessera.session import write_table

#: Runs of white space as the size counts them.
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    words = F.split(text, SPACE)
    return F.coalesce(F.size(F.filter(words, lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def source_targets(per_source: DataFrame, weights: Sequence[float], budget: float, max_rate: float) -> DataFrame:
    """Targets of the sources of ``per_source(source, source_size)``.

    The sources, by code point with null last, weigh ``weights`` in turn and share
    ``budget`` times all sizes. No target passes ``max_rate`` times its source's size; what
    is above goes to the others by weight. Sorted by cap over weight the capped sources
    come first, so the level they leave is a running sum: one row per source, no loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "_rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onwards = F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        per_source.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_weight", weight)
        .withColumn("_cap", max_rate * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_level", (budget * F.col("_total") - before) / onwards)
        .withColumn("_level", F.max("_level").over(everything))
        .select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target"))
    )


@dataclass
class Mix:
    """The documents, with their columns numbered, and ``size, source_size, target, copies`` of each."""

    rows: DataFrame
    columns: list[str]

    def emit_copies(self) -> DataFrame:
        """Each document as many times as it has copies, with its own columns."""
        many = self.rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        return many.select(*(f"c{i}" for i in range(len(self.columns)))).toDF(*self.columns)

    def report(self) -> DataFrame:
        """Per document what the mix takes of it."""
        doc_id = F.col(f"c{self.columns.index('doc_id')}").alias("doc_id")
        return self.rows.select(doc_id, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    max_rate: float = 2.0,
    seed: int = 20,
) -> Mix:
    """``size, source_size, target, copies`` of every row of ``docs``.

    ``copies`` is floor(rate) plus one with the probability of the fraction, where
    rate = target / source size, drawn from a hash of the seed and the id (of the text
    where the id is null). Thus reruns and lost executors give the same copies, and rows
    that repeat an id share the draw.

    Null or empty texts have size 0 and count as their source's documents; a source whose
    size is 0 has target 0 and no copies. Null sources are one source, the last. An empty
    table gives an empty result. Other columns, whatever their names, pass through unread.

    The targets take one row a source through one task, so sources are to be names of
    collections (a million of them is no trouble), not of documents.
    """
    own, name = numbered(docs)
    sized = own.withColumn("size", word_count(F.col(name["text"])))
    per_source = sized.groupBy(F.col(name["source"]).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = write_table(source_targets(per_source, weights, budget, max_rate), "mix-targets")
    key = F.coalesce(F.col(name["doc_id"]).cast("string"), F.md5(F.col(name["text"]).cast("binary")), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    rows = (
        sized.join(targets, F.col(name["source"]).eqNullSafe(F.col("source")))
        .withColumn("rate", rate)
        .withColumn("copies", copies.cast("long"))
        .drop("source", "rate")
    )
    return Mix(rows, docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS size
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk, sum(source_size) OVER ()::DOUBLE AS total FROM per_source),
weighed AS (SELECT *, ([3.0, 1.0, 2.0])[((rk - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM weighed),
targets AS (SELECT source, source_size, least(cap, (max(own_level) OVER ()) * w) AS target FROM levels),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('20:' || coalesce(s.doc_id::VARCHAR, md5(s.text), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
