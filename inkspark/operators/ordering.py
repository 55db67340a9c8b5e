"""One order over a whole table, in slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.sources.scratch import written

SLICE_ROWS = 500_000  # about 50 MB to a sort of short rows


def in_slices(rows: DataFrame, order: list[Column | str], name: str = "ordered") -> DataFrame:
    """The rows written in one order: ``slice`` numbers the pieces, ``place`` the rows of a piece, from 0. Both are in order."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(placed, name)  # the id is that of the partition, shifted by 33 bits, and the row in it
    return placed.select(*rows.columns, F.shiftright("_id", 33).cast("int").alias("slice"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))


def sized_slices(rows: DataFrame, *keys: str, most: int = SLICE_ROWS) -> DataFrame:
    """Rows dealt by keys over as many partitions as keep them at about ``most`` rows; as they are where the session's number does."""
    wanted = -(-rows.count() // most)
    return rows.repartition(wanted, *keys) if wanted > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def numbered_whole(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Rows with their place (from 1) in an order of the whole table: places in slices, behind the sizes of the slices before."""
    placed = in_slices(rows, order)
    sizes = placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each slice
    return placed.join(F.broadcast(sizes.select("slice", before.alias("_before"))), "slice").select(*rows.columns, (F.col("_before") + F.col("place") + 1).alias(name))
