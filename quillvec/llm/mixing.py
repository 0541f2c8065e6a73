"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.llm.common import SPACE_GAP, documents, running
from quillvec.session import settle

MAX_EPOCHS = 3
WEIGHTS = [5, 2, 1]
SEED = 17
# Once no more rows than this can still fit, the driver ends the walk over them; the rows taken are the same.
TAIL_ROWS = 20_000


def word_count(text: Column) -> Column:
    """The number of words between white space; 0 for null."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_GAP, " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add `target` to `sources` (source, source_size, weight); one row per source.

    All sizes are shared by weight; a share above max_epochs times its source's size is held there and the rest is
    shared again. Ordered by cap / weight, the held sources are a prefix, so one pass over running sums finds the level.
    """
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = sources.select(
        "*",
        cap.cast("double").alias("_cap"),
        # What a unit of weight gets if exactly the sources before this one are held at their caps.
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("_level"),
    )
    # The level rises while sources are held and falls behind the last of them, so the largest is the final one.
    return levels.select(
        *sources.columns, F.least(F.col("_cap"), F.col("weight") * F.max("_level").over(everything)).alias("target")
    )


def source_targets(sized: DataFrame, weights: list[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source with its size, weight and target; weights repeat over sources in code-point order."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return water_fill(sources.withColumn("weight", weight), max_epochs)


def still_fitting(walked: DataFrame) -> DataFrame:
    """Rows of `walked` that were not taken and are no larger than what is now open in their source, with that `_gap`."""
    gaps = walked.groupBy(F.col("source").alias("_source")).agg(
        (F.first("_gap") - F.coalesce(F.sum(F.when(F.col("_fits"), F.col("size"))), F.lit(0))).alias("_gap")
    )
    left = walked.where(~F.col("_fits")).select("source", "size", "row_index", "_part")
    return left.join(gaps, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("size") <= F.col("_gap") + F.lit(1e-6)).drop("_source")


def later_fits(walked: DataFrame) -> DataFrame:
    """`_picked`: the row_index of each row that still fits after the first that did not, in the order of row_index.

    `walked` (source, size, row_index, _part, _gap, _fits) has the rows before that one in `_fits`, and in `_gap` what
    was open before them. The gap only falls, so rows above it are out for good; a running sum over the others takes
    at least the first of each source, up to the next that does not fit, until none is left that fits.
    """
    spark = walked.sparkSession
    picks = spark.createDataFrame([], "_picked long")
    while True:
        left = settle(still_fitting(walked), "left")
        if left.count() <= TAIL_ROWS:
            break
        # One row per source and range.
        sums = left.groupBy(F.col("source").alias("_source"), F.col("_part").alias("_range")).agg(F.sum("size").alias("_sum"))
        above = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("_source", "_range", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_from"))
        upto = Window.partitionBy("_part", "source").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
        summed = left.withColumn("_upto", F.sum("size").over(upto)).join(
            offsets, (F.col("_part") == F.col("_range")) & F.col("source").eqNullSafe(F.col("_source"))
        )
        walked = settle(
            summed.select(*left.columns, (F.col("_from") + F.col("_upto") <= F.col("_gap") + F.lit(1e-6)).alias("_fits")), "fill"
        )
        picks = picks.union(walked.where("_fits").select(F.col("row_index").alias("_picked")))
    gaps, picked = {}, []
    for r in sorted(left.select("source", "size", "row_index", "_gap").collect(), key=lambda r: r["row_index"]):
        gap = gaps.setdefault(r["source"], r["_gap"])
        if r["size"] <= gap + 1e-6:
            gaps[r["source"]] = gap - r["size"]
            picked.append((r["row_index"],))
    return picks.union(spark.createDataFrame(picked, "_picked long"))


def mix(df: DataFrame, key: str, source: Column, size: Column, weights: list[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How often the mix repeats each row of `df`.

    Every row is repeated floor(target / source_size) times; then a walk over all rows in a seeded order gives one more
    repetition to each that still fits below the target. No row is cut, so a source misses its target by less than
    its smallest row of any size that was left out, and no row has over `max_epochs` repetitions.
    Null sources form one source, rows without words count 0 and are repeated alike; an empty table gives no rows.
    Returns key, source, size, source_size, target, repeats.
    """
    narrow = settle(
        df.select(F.col(key).alias("key"), source.alias("source"), size.alias("size"))
        .withColumn("_draw", F.xxhash64(F.lit(seed), "key", "size")),
        "sizes",
    )
    targets = settle(source_targets(narrow, weights, max_epochs), "targets")
    run = running(narrow, ["source", "_draw", "key", "size"], ["size"], "mix")
    quota = F.col("target") - F.col("whole") * F.col("source_size")
    starts = targets.select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(1).alias("whole"),
        F.coalesce(
            F.sum("source_size").over(Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_source_start"),
    ).withColumn("quota", quota)
    placed = run.join(starts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_fits", (F.col("before_size") - F.col("_source_start") + F.col("size") <= F.col("quota") + F.lit(1e-6)) & (F.col("quota") > 0.5)
    )
    placed = settle(
        placed.select("key", "source", "size", "source_size", "target", "whole", "quota", "row_index", "_part", "_fits"), "repeats"
    )
    picks = later_fits(placed.where("size > 0").withColumnRenamed("quota", "_gap"))
    done = placed.join(picks, F.col("row_index") == F.col("_picked"), "left")
    extra = (F.col("_fits") | F.col("_picked").isNotNull()).cast("long")
    return done.select(
        F.col("key").alias(key), "source", "size", "source_size", "target", (F.col("whole") + extra).cast("long").alias("repeats")
    )


def query(spark, sf: str) -> DataFrame:
    """All documents, mixed by words."""
    mixed = mix(documents(spark, sf), "doc_id", F.col("source"), word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats")


def stage(spark, docs: DataFrame, sf: str) -> DataFrame:
    """Documents as often as the mix repeats them; those that it never takes go.

    Rows without doc_id are repeated as one doc_id would be; an empty table stays empty; other columns come back as they
    are.
    """
    mixed = mix(docs, "doc_id", F.col("source"), word_count(F.col("text")))
    # Rows of one doc_id share the mean of their repeats, rounded up; doc_id is unique in the pipeline.
    times = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.ceil(F.avg("repeats")).cast("int").alias("_times")).where("_times > 0")
    joined = docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_times")).alias("_copy")).drop("_copy")
