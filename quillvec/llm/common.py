"""Helpers that several of these operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.session import settle

# Words of letters, digits and anything beyond ASCII.
PLAIN_WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Words between white space.
SPACE_GAP = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. `lower` does the same, faster, on a text of ASCII only."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column, gap: str) -> Column:
    """The words of a lower-cased text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def running(df: DataFrame, order: list[str], sums: list[str], label: str) -> DataFrame:
    """Number the rows of a narrow `df` in a global order and add running totals of what stands before each.

    Adds `row_index` (gapless from 0) and `before_<column>` for each of `sums`. Rows are range-partitioned on the
    whole order, written once with their partition's number, and shifted by one offset per partition; no task sees
    more than its range. Name enough order columns to tell rows apart: equal rows get their numbers in any order.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    totals = ranged.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums]
    )
    # One row per partition.
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_first"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(above), F.lit(0)).alias(f"_from_{c}") for c in sums],
    )
    within = Window.partitionBy("_part").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_place", F.row_number().over(within).cast("long") - 1)
    for c in sums:
        placed = placed.withColumn(f"_before_{c}", F.coalesce(F.sum(c).over(earlier), F.lit(0)))
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.select(
        *df.columns,
        "_part",
        (F.col("_first") + F.col("_place")).alias("row_index"),
        *[(F.col(f"_from_{c}") + F.col(f"_before_{c}")).alias(f"before_{c}") for c in sums],
    )


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark, size: str = "4m") -> Iterator[None]:
    """Hand rows to Python in batches of a few MB while the block runs its jobs, so that texts of any length fit."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


OWN_KEY = "__own_key__"


def with_own_key(docs: DataFrame) -> DataFrame:
    """Add OWN_KEY, a text that stands for the row: its doc_id or, where that is null, its own text."""
    by_text = F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit(""))))
    return docs.withColumn(OWN_KEY, F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), by_text))


def documents(spark, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")
