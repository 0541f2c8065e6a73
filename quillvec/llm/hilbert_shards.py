"""Sharding: order rows along a Hilbert curve over several metadata dimensions and cut runs of near-equal bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import documents, running
from quillvec.session import settle

SHARDS = 16
# Groups above this part of a shard are given shards before all other rows are.
SMALL = 50
# 2^BITS cells for each dimension.
BITS = 5


def value_cells(df: DataFrame, name: str, rows: int, bits: int = BITS) -> DataFrame:
    """`_value` and `_cell` of every distinct value of a string column of `df`, which has `rows` rows.

    Values are ordered as a whole and cut at equal shares of the rows.
    """
    counts = df.groupBy(F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_held"))
    run = running(counts, ["_value"], ["_held"], "values")
    cell = F.expr(f"cast(({2**bits} * before__held) div {rows or 1} as int)")
    return settle(run.select("_value", cell.alias("_cell")), "cells")


def cell_bounds(df: DataFrame, names: list[str], bits: int = BITS) -> dict[str, list]:
    """At most 2^bits - 1 rising values for each numeric dimension, at equal shares of the rows."""
    if not names:
        return {}
    shares = [i / 2**bits for i in range(1, 2**bits)]
    row = df.select([F.percentile_approx(n, shares, F.lit(2000)).alias(n) for n in names]).first()
    return {n: sorted(set(row[n] or [])) for n in names}


def cell(code: Column, bounds: list) -> Column:
    """The number of bounds below the value."""
    return reduce(lambda a, b: a + b, [(code > b).cast("int") for b in bounds], F.lit(0))


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place of a grid cell on the Hilbert curve, as one long of len(cells) * bits bits.

    The usual transpose form: fold over (bit, axis) from the highest bit, then Gray-code the axes and interleave.
    """
    n = len(cells)
    steps = F.array(*[
        F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)
    ])

    def turn(axes: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        first, here = F.element_at(axes, 1), F.element_at(axes, i + 1)
        low = q - 1
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        return F.transform(
            axes,
            lambda v, j: F.when(here.bitwiseAND(q) != 0, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
                F.when((i > 0) & ((j == 0) | (j == i)), v.bitwiseXOR(swap)).otherwise(v)
            ),
        )

    turned = F.aggregate(steps, F.array(*[c.cast("int") for c in cells]), turn)
    # Gray code: each axis takes the exclusive or of all axes up to it.
    gray = F.transform(
        turned, lambda v, j: F.aggregate(F.slice(turned, F.lit(1), j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b))
    )
    flips = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    last = F.element_at(gray, -1)
    flip = F.aggregate(
        flips, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
    )
    places = F.array(*[
        F.struct(F.lit(b).alias("b"), F.lit(i + 1).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)
    ])
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("h"), gray.alias("g"), flip.alias("f")),
        lambda s, p: F.struct(
            (
                F.shiftleft(s["h"], 1)
                + F.call_function(
                    "getbit", F.element_at(s["g"], p["i"]).bitwiseXOR(s["f"]).cast("long"), p["b"]
                ).cast("long")
            ).alias("h"),
            s["g"].alias("g"),
            s["f"].alias("f"),
        ),
        lambda s: s["h"],
    )


def shard_by_curve(
    df: DataFrame, key: str, size: Column, group: Column, dims: list[Column], carry: dict[str, Column], shards: int = SHARDS
) -> DataFrame:
    """Give every row of `df` a shard and a gapless slot, along the curve over `dims`.

    Rows of one `group` stand together at the place of its row with the smallest `key`, and a group that fits a shard
    stays in one: a small one where its place falls, one above 1/SMALL of a shard in the shard of its place or, if that
    has no room left, in the emptiest. Only a group larger than a shard, or than all room left, is cut by rows. The
    shards' bytes stay within about 1/SMALL of a shard, or the largest row, of each other.
    Dimensions are strings or whole numbers. A null dimension counts as its lowest value, a null key comes first, repeated rows get a slot each, an empty table
    gives no rows. Returns key, the `carry` columns, size, curve, shard, slot.
    """
    names = [f"_d{i}" for i in range(len(dims))]
    strings = {n for n, kind in df.select(*[d.alias(n) for d, n in zip(dims, names)]).dtypes if kind == "string"}
    narrow = settle(
        df.select(
            F.col(key).alias("_key"),
            size.cast("long").alias("_size"),
            group.alias("_group"),
            *[(F.coalesce(d, F.lit("")) if n in strings else F.coalesce(d.cast("long"), F.lit(-(2**62)))).alias(n) for d, n in zip(dims, names)],
            F.struct(F.lit(0).alias("_none"), *[c.alias(n) for n, c in carry.items()]).alias("_carry"),
        ),
        "metadata",
    )
    bounds = cell_bounds(narrow, [n for n in names if n not in strings])
    total, count = narrow.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    groups = narrow.groupBy("_group").agg(
        F.min(F.struct("_key", *names)).alias("_lead"), F.sum("_size").alias("_group_size"), F.count(F.lit(1)).alias("_copies")
    ).select("_group", "_group_size", "_copies", *[f"_lead.{n}" for n in names])
    for n in sorted(strings):
        groups = groups.join(value_cells(narrow, n, count), F.col(n) == F.col("_value")).drop(n, "_value").withColumnRenamed("_cell", n)
    cells = [F.col(n) if n in strings else cell(F.col(n), bounds[n]) for n in names]
    groups = groups.select("_group", "_group_size", "_copies", curve_index(cells).alias("_curve"))
    rows = narrow.join(groups, "_group").select("_key", "_size", "_carry", "_group", "_group_size", "_copies", "_curve")
    run = settle(running(rows, ["_curve", "_group", "_key"], ["_size"], "curve"), "placed")
    # A range bound can divide a group, so its start is taken over the whole group.
    several = run.where("_copies > 1").groupBy("_group", "_group_size").agg(F.min("before__size").alias("_start"))
    heavy = (F.col("_group_size") * (SMALL * shards) > total) & (F.col("_group_size") * shards <= total)
    homes, filled = group_homes(several.where(heavy), total, shards)
    placed = F.broadcast(df.sparkSession.createDataFrame(homes, "_home_of string, _home int"))
    run = run.join(placed, F.col("_group").cast("string") == F.col("_home_of"), "left").drop("_home_of")
    if homes:
        # The other rows fill what the groups with a home leave of each shard, so they are numbered among themselves.
        columns = [F.col(c) for c in (*rows.columns, "_home")]
        light = settle(running(run.where("_home IS NULL").select(*columns), ["_curve", "_group", "_key"], ["_size"], "light"), "light")
        housed = run.where("_home IS NOT NULL").select(*columns)
        several = light.where("_copies > 1").groupBy("_group", "_group_size").agg(F.min("before__size").alias("_start"))
    else:
        light, housed = run, None
    light = cut_light(light, several.where(F.col("_group_size") * (SMALL * shards) <= total), total, filled)
    # One row per shard.
    firsts = light.groupBy("_shard").agg(F.min("row_index").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    out = light.join(F.broadcast(firsts), "_shard").withColumn("_slot", F.col("row_index") - F.col("_first"))
    wanted = ["_key", "_size", "_carry", "_curve", "_shard", "_slot"]
    out = out.select(*wanted)
    if housed is not None:
        # Behind the other rows of its shard, in the order of the curve.
        counted = settle(running(housed.withColumnRenamed("_home", "_shard"), ["_shard", "_curve", "_group", "_key"], [], "housed"), "housed")
        begins = counted.groupBy("_shard").agg(F.min("row_index").alias("_begin")).join(firsts, "_shard", "left")
        behind = counted.join(F.broadcast(begins), "_shard").withColumn(
            "_slot", F.col("row_index") - F.col("_begin") + F.coalesce("_rows", F.lit(0))
        )
        out = out.unionByName(behind.select(*wanted))
    return out.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        *[F.col(f"_carry.{n}") for n in carry],
        F.col("_curve").alias("curve"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
    )


def group_homes(groups: DataFrame, total: int, shards: int) -> tuple[list[tuple[str, int]], list[int]]:
    """A shard for each of `groups` (_group, _group_size, _start) that one can take whole, and the bytes so taken.

    The largest first, each to the shard that its place on the curve falls in, else to the emptiest. A group that no
    shard has room for is left out and cut like any rows. Only groups above 1/SMALL of a shard come here, so there are
    fewer than SMALL * shards of them, whatever the table holds.
    """
    room = total / shards
    taken, homes = [0] * shards, []
    for g in sorted(groups.collect(), key=lambda g: (-g["_group_size"], g["_start"])):
        size = g["_group_size"]
        own = min(shards - 1, shards * (2 * g["_start"] + size) // (2 * total))
        best = own if taken[own] + size <= room else min(range(shards), key=lambda s: taken[s])
        if taken[best] + size <= room:
            taken[best] += size
            homes.append((str(g["_group"]), best))
    return homes, taken


def cut_light(run: DataFrame, groups: DataFrame, total: int, taken: list[int]) -> DataFrame:
    """Add `_shard`: each row goes where its middle falls in the room the shards have left, one of `groups` as a whole."""
    shards = len(taken)
    # Twice the bytes times the number of shards, so that ends are whole numbers.
    ends, end = [], 0
    for t in taken:
        end += 2 * total - 2 * shards * t
        ends.append(end)
    starts = groups.select(F.col("_group").alias("_of"), "_start")
    small = F.coalesce((F.col("_copies") > 1) & (F.col("_group_size") * (SMALL * shards) <= total) & F.col("_group").isNotNull(), F.lit(False))
    # Rows of large groups are not joined, so no task gets a large group.
    alone = run.where(~small).withColumn("_middle", F.col("before__size") * 2 + F.col("_size"))
    together = run.where(small).join(starts, F.col("_group") == F.col("_of")).withColumn("_middle", F.col("_start") * 2 + F.col("_group_size"))
    shard = reduce(lambda a, b: a + b, [(F.col("_middle") * shards >= e).cast("int") for e in ends[:-1]], F.lit(0))
    return alone.unionByName(together.select(*alone.columns)).withColumn("_shard", shard)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def document_dims() -> list[Column]:
    return [F.col("lang"), F.col("source"), F.length(F.coalesce("text", F.lit("")))]


def query(spark, sf: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes, ordered by language, source and length."""
    docs = documents(spark, sf)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    placed = shard_by_curve(
        docs, "doc_id", text_size(F.col("text")), F.xxhash64("text"), document_dims(), {"text_crc32": crc}
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def stage(spark, docs: DataFrame, sf: str) -> DataFrame:
    """Documents with their shard, in files cut along the curve. Rows of one doc_id go to one shard.

    Columns named shard or curve are replaced.
    """
    size = text_size(F.col("text"))
    one = docs.groupBy("doc_id").agg(
        F.sum(size).alias("_bytes"), F.min(F.struct(F.xxhash64("text").alias("h"), *[d.alias(f"d{i}") for i, d in enumerate(document_dims())])).alias("_meta")
    )
    placed = shard_by_curve(
        one, "doc_id", F.col("_bytes"), F.col("_meta.h"), [F.col(f"_meta.d{i}") for i in range(3)], {}
    ).select(F.col("doc_id").alias("_id"), "shard", "curve")
    joined = docs.drop("shard", "curve").join(placed, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    return joined.repartitionByRange("shard", "curve", "doc_id").sortWithinPartitions("shard", "curve", "doc_id")
