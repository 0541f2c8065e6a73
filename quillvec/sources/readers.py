"""Reading tables, page text, catalogues and corpora."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillvec import constants as const
from quillvec.functions.text import file_name_of, table_name_from_file
from quillvec.operators.clean import coerce_product_cells, normalized_names, require_fields
from quillvec.session import settle
from quillvec.sources.sinks import noted_schema

FORMAT_GLOBS = {"csv": "*.csv", "json": "*.json", "parquet": "*.parquet", "text": "*.txt", "orc": "*.orc"}


def _real_file(name: Column) -> Column:
    return ~name.startswith(const.TEMP_FILE_PREFIX)


def list_table_files(spark: SparkSession, directory: str, fmt: str = "csv", prefix: str | None = None) -> DataFrame:
    """(path, file, table_name, length, source_file) of every table file below a directory, temporary files left out.

    Only the listing is read, not the contents. Files of zero bytes are not listed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", FORMAT_GLOBS[fmt]).option("recursiveFileLookup", True).load(directory)
    return files.select(
        "path",
        file_name_of(F.col("path")).alias("file"),
        table_name_from_file(F.col("path"), prefix).alias("table_name"),
        "length",
        F.col("_metadata.file_path").alias("source_file"),
    ).filter(_real_file(F.col("file")))


def _with_row_index(df: DataFrame) -> DataFrame:
    """0-based row number within each file, without moving the rows.

    A file split is read by one task from front to back, so a row's place in its split is its distance from
    the split's smallest increasing id; splits before it add their row counts.
    """
    placed = df.withColumn("_mono", F.monotonically_increasing_id())
    splits = placed.groupBy("_file", "_start").agg(F.min("_mono").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    numbered = placed.join(offsets, ["_file", "_start"])
    index = F.col("_before") + F.col("_mono") - F.col("_first")
    return numbered.withColumn("row_index", index).drop("_mono", "_first", "_before", "_start")


LINE = "line string, source_file string, start long, place long, odd boolean, blank boolean, turns long, rows_out long, rows_in long"


def _scan_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over the lines of a file split that stand before each line.

    `place`: lines; `turns`: lines that leave a quoted cell open, or close it; `rows_out`, `rows_in`: records that begin,
    if the split begins outside a quoted cell, or inside one.
    """
    carried: dict[tuple, np.ndarray] = {}
    for batch in batches:
        names, starts = batch.column("source_file"), batch.column("start").to_numpy()
        odd, filled = (np.asarray(batch.column(c)).astype(np.int64) for c in ("odd", "filled"))
        numbers = names.dictionary_encode().indices.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(numbers) != 0) | (np.diff(starts) != 0)])) if len(odd) else []
        out = np.zeros((4, len(odd)), dtype=np.int64)
        for a, b in zip(heads, [*heads[1:], len(odd)]):
            key = names[int(a)].as_py(), int(starts[a])
            place, turns, rows_out, rows_in = carried.pop(key, np.zeros(4, dtype=np.int64))
            before = turns + np.cumsum(odd[a:b]) - odd[a:b]
            inside = before % 2
            begun = filled[a:b] * (1 - inside), filled[a:b] * inside
            out[0, a:b] = place + np.arange(b - a)
            out[1, a:b] = before
            out[2, a:b] = rows_out + np.cumsum(begun[0]) - begun[0]
            out[3, a:b] = rows_in + np.cumsum(begun[1]) - begun[1]
            # A task reads its splits one after the other.
            carried = {key: np.array([place + b - a, before[-1] + odd[b - 1], rows_out + begun[0].sum(), rows_in + begun[1].sum()])}
        yield pa.record_batch(
            [
                batch.column("line"), names, batch.column("start"), pa.array(out[0]), pa.array(odd == 1), pa.array(filled == 0),
                *(pa.array(o) for o in out[1:]),
            ],
            names=["line", "source_file", "start", "place", "odd", "blank", "turns", "rows_out", "rows_in"],
        )


def read_records(spark: SparkSession, directory: str, fmt: str = "csv") -> DataFrame:
    """CSV records of all table files below a directory: line, source_file (the whole path) and 0-based row_index.

    A quoted cell may hold line breaks; files are split all the same. Whether a line begins inside a quoted cell follows
    from the number of quotes before it: counted within each split, then over the splits of its file. Lines that are a
    record by themselves stay where they are; the others meet by record. A quote amid an unquoted cell (5" pipe) doesn't
    count. Blank lines between records are left out. The lines are written once, below the session's shared folder.
    """
    text = spark.read.option("pathGlobFilter", FORMAT_GLOBS[fmt]).option("recursiveFileLookup", True).text(directory)
    quotes = F.regexp_replace("value", r'(?<=[^,"])"(?=[^,"])', "")
    tagged = text.filter(_real_file(F.col("_metadata.file_name"))).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("start"),
        (F.regexp_count(quotes, F.lit('"')) % 2 == 1).alias("odd"),
        (F.length(F.trim("value")) > 0).alias("filled"),
    )
    lines = settle(tagged.mapInArrow(_scan_splits, LINE), "lines")
    begins = F.col("blank").eqNullSafe(False)
    inside = F.col("turns") % 2
    splits = lines.groupBy("source_file", "start").agg(
        F.count_if("odd").alias("_turns"), F.count_if(begins & (inside == 0)).alias("_out"), F.count_if(begins & (inside == 1)).alias("_in")
    )
    # One row per split of a file.
    earlier = Window.partitionBy("source_file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    entered = splits.withColumn("_open", F.coalesce(F.sum("_turns").over(earlier), F.lit(0)) % 2 == 1)
    records = F.when(F.col("_open"), F.col("_in")).otherwise(F.col("_out"))
    offsets = entered.select("source_file", "start", "_open", F.coalesce(F.sum(records).over(earlier), F.lit(0)).alias("_before"))
    placed = lines.join(F.broadcast(offsets), ["source_file", "start"])
    index = F.col("_before") + F.when(F.col("_open"), F.col("rows_in")).otherwise(F.col("rows_out"))
    continued = (F.col("turns") % 2 == 1) != F.col("_open")
    found = placed.withColumn("_continued", continued).withColumn("row_index", F.when(F.col("_continued"), index - 1).otherwise(index))
    whole = found.filter(~F.col("_continued") & ~F.col("odd") & ~F.col("blank")).select("line", "source_file", "row_index")
    pieces = found.filter(F.col("_continued") | F.col("odd")).groupBy("source_file", "row_index").agg(
        F.sort_array(F.collect_list(F.struct("start", "place", "line")))["line"].alias("pieces")
    )
    return whole.unionByName(pieces.select(F.array_join("pieces", "\n").alias("line"), "source_file", "row_index"))


def read_table_files(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "csv",
    header_row: int = 0,
    glob: str | None = None,
    infer_types: bool = True,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """Rows of all table files with `source_file` and 0-based `row_index`, temporary files left out.

    CSV headers sit in line `header_row`; lines above it are skipped. Files read together share one header.
    `multi_line` admits line breaks inside quoted cells, at the price that a file is no longer split.
    """
    reader = spark.read.option("pathGlobFilter", glob or FORMAT_GLOBS[fmt])
    if fmt == "parquet":
        rows = reader.parquet(path) if isinstance(path, str) else reader.parquet(*path)
        return (
            rows.select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("row_index"))
            .filter(_real_file(F.col("source_file")))
        )
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "csv":
        reader = reader.option("header", header_row == 0).option("multiLine", multi_line).option("encoding", encoding)
        reader = reader.option("enforceSchema", False) if header_row == 0 else reader
        rows = reader.option("inferSchema", infer_types and header_row == 0).csv(paths)
    else:
        rows = reader.format(fmt).load(paths)
    data = rows.columns
    tagged = rows.select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
    ).filter(_real_file(F.col("_file")))
    numbered = _with_row_index(tagged).withColumnRenamed("_file", "source_file")
    if fmt == "csv" and header_row > 0:
        numbered = _lift_header(numbered, data, header_row)
        if infer_types:
            numbered = narrow_types(numbered, [c for c in numbered.columns if c not in ("source_file", "row_index")])
    return numbered


NARROW_TYPES = ["int", "bigint", "double", "boolean"]


def _as_kind(text: Column, kind: str) -> Column:
    """The value of a text cell in a narrower type, null if it is not written like one."""
    shape = r"^(?i:true|false)$" if kind == "boolean" else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(shape), trimmed.try_cast(kind))


def narrow_types(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text columns as the first of int, bigint, double and boolean that all their values fit; one aggregation."""
    if not names:
        return rows
    cell = {n: F.col("`" + n.replace("`", "``") + "`") for n in names}
    counts = rows.agg(*[
        c
        for i, n in enumerate(names)
        for c in [
            F.count(cell[n]).alias(f"n{i}"),
            *[F.count(_as_kind(cell[n], kind)).alias(f"{kind}{i}") for kind in NARROW_TYPES],
        ]
    ]).first()
    found = {
        n: next((kind for kind in NARROW_TYPES if counts[f"n{i}"] and counts[f"{kind}{i}"] == counts[f"n{i}"]), "string")
        for i, n in enumerate(names)
    }
    typed = {n: _as_kind(cell[n], kind) for n, kind in found.items() if kind != "string"}
    return rows.withColumns(typed) if typed else rows


def _lift_header(rows: DataFrame, columns: Sequence[str], header_row: int) -> DataFrame:
    """Take names from line `header_row`, drop it and all lines above, and number rows from 0 again."""
    header = rows.filter(F.col("row_index") == header_row).select(*columns).first()
    if header is None:
        return rows.filter(F.lit(False))
    below = rows.filter(F.col("row_index") > header_row).withColumn("row_index", F.col("row_index") - header_row - 1)
    return below.select(
        *[F.col(old).alias(new) for old, new in zip(columns, normalized_names(header))], "source_file", "row_index"
    )


def read_pages(
    spark: SparkSession, path: str, fmt: str = "parquet", source: str = "source", page: str = "page", text: str = "text"
) -> DataFrame:
    """Page text as (source, page, text, file_name); pages count from 0."""
    if fmt == "text":
        # One file per page, named `<document>_<page>.txt`, or a document of one page.
        whole = spark.read.option("pathGlobFilter", FORMAT_GLOBS[fmt]).text(path, wholetext=True)
        name = F.col("_metadata.file_name")
        number = F.nullif(F.regexp_extract(name, r"_(\d+)\.[^.]*$", 1), F.lit(""))
        rows = whole.select(
            F.col("_metadata.file_path").alias("source"),
            F.coalesce(number.cast("int"), F.lit(0)).alias("page"),
            F.col("value").alias("text"),
        )
        return as_pages(rows, "source", "page", "text")
    return as_pages(spark.read.format(fmt).load(path), source, page, text)


def as_pages(rows: DataFrame, source: str, page: str, text: str) -> DataFrame:
    path = F.col(source).cast("string")
    return rows.select(
        path.alias("source"),
        F.coalesce(F.col(page).cast("int"), F.lit(0)).alias("page"),
        F.col(text).alias("text"),
        file_name_of(path).alias("file_name"),
    )


def as_products(rows: DataFrame) -> DataFrame:
    """Typed catalogue from untyped cells, rows without their key fields dropped."""
    return require_fields(coerce_product_cells(rows), const.REQUIRED_PRODUCT_COLUMNS)


def read_products(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", multi_line)
    return as_products(reader.format(fmt).load(path))


def load_corpus(spark: SparkSession, location: str, table: bool = False) -> DataFrame:
    """Re-open a written corpus; parts written before a column was added read it as null.

    The columns come from the notes that loads leave, one small folder; without notes, from the footers of all files.
    """
    if table:
        return spark.table(location)
    schema = noted_schema(spark, location)
    return spark.read.option("mergeSchema", True).parquet(location) if schema is None else spark.read.schema(schema).parquet(location)
