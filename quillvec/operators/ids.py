"""Dense global numbers and running totals without a single-partition window and without moving rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.session import OPEN_FILES, held_setting, scratch_path, settle

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position of a partition in the low 33 bits
# Rows of order keys sorted by one task.
RANGE_ROWS = 4_000_000
# A slice is 2^12 rows that one task wrote one after the other; their numbers travel as one array of 32 KB at most. Slices
# are dealt to buckets by hash: with few large ones some buckets would get none and others several.
_SLICE_BITS = 12


def next_id(existing: DataFrame | None, column: str = "id") -> int:
    """The first free id: one above the current maximum."""
    if existing is None:
        return 1
    return (existing.agg(F.max(column)).first()[0] or 0) + 1


def _in_slices(df: DataFrame) -> DataFrame:
    """The rows, written once where they are: with their place, bucketed by slice.

    A task's slices are few, so it keeps their files open instead of sorting rows by bucket. The table's name goes at
    once; its files stay in the shared folder.
    """
    spark = df.sparkSession
    name = f"quillvec_rows_{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id()
    placed = df.withColumn("__place", place).withColumn("__slice", F.shiftright("__place", _SLICE_BITS))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with held_setting(spark, OPEN_FILES, "64"):
        placed.write.option("path", scratch_path(spark, "rows")).bucketBy(buckets, "__slice").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def running_total(
    df: DataFrame, order_by: Sequence[str], column: str, start: int = 0, size: Column | None = None, partitions: int | None = None
) -> DataFrame:
    """`start` plus the sum of `size` (1 if not given) over all rows before each row in the order.

    Rows equal in the order keep their input order. The rows are written once, which runs their input once. Only order
    keys, sizes and places are sorted: range-partitioned on key and place, so a hot key spreads, with offsets from one
    total per range. The totals go, an array per slice, to where the slices lie (the rows' buckets), so rows are neither
    shuffled nor sorted. Written rows stay when executors are lost.
    """
    rows = _in_slices(df)
    keys = rows.select(*order_by, "__place", (F.lit(1) if size is None else size).cast("long").alias("__size"))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = partitions or max(least, -(-rows.count() // RANGE_ROWS))
    order = [*order_by, "__place"]
    ranged = keys.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id())
    if size is None:
        position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
        placed = ranged.sortWithinPartitions(*order).withColumn("__before", position)
    else:
        earlier = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        placed = ranged.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    ranked = settle(placed.select("__place", "__size", "__range", "__before"), "ranks")
    totals = ranked.groupBy("__range").agg(F.sum("__size").alias("__n"))
    above = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    offsets = totals.select("__range", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__offset"))
    numbers = ranked.join(F.broadcast(offsets), "__range").select(
        F.shiftright("__place", _SLICE_BITS).alias("__slice"),
        F.struct("__place", (F.col("__offset") + F.col("__before") + F.lit(start)).alias("n")).alias("__number"),
    )
    # A task numbers its rows without gaps, so a row's place in its slice is its place in the array.
    arrays = numbers.groupBy("__slice").agg(F.sort_array(F.collect_list("__number"))["n"].alias("__numbers"))
    at = F.col("__place").bitwiseAND((1 << _SLICE_BITS) - 1).cast("int")
    found = rows.join(arrays.hint("shuffle_hash"), "__slice")
    return found.withColumn(column, F.get("__numbers", at)).drop("__slice", "__place", "__numbers")


def assign_ids(
    df: DataFrame, order_by: Sequence[str], column: str = "id", start: int = 1, partitions: int | None = None
) -> DataFrame:
    """Consecutive numbers by row order, starting at `start` (see `running_total`)."""
    return running_total(df, order_by, column, start, partitions=partitions)
