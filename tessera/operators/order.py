"""A total order over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import write_table


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with its place in ``order``, from 1 on.

    The rows are range-partitioned and sorted, so a row's place is its place in its partition
    and the number of rows in those before, which a table of a row a partition gives.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = write_table(ranged.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row a partition
    return joined.withColumn(name, F.col("_before") + own + 1).drop("_id", "_part", "_before")
