"""Writing corpora and tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quillvec import constants as const
from quillvec.session import held_setting

# The folder beside a corpus' rows that holds the notes of its columns.
NOTES = "_columns"
# Lists in two levels instead of three, one call a value instead of five: most of a vector's write are such calls. Spark
# reads both layouts, in one folder too.
TWO_LEVEL_LISTS = "spark.sql.parquet.writeLegacyFormat"


def append_corpus(
    df: DataFrame,
    location: str,
    mode: str = "append",
    table: bool = False,
    partition_by: Sequence[str] = (),
    dedupe_key: Sequence[str] = (),
) -> None:
    """Append rows, or overwrite to recreate. A job's rows arrive together or not at all.

    Reloads append again by default. With `dedupe_key`, rows whose key is already stored, or repeats within
    the load, are left out.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode is 'append' or 'overwrite'")
    if dedupe_key:
        df = df.dropDuplicates(list(dedupe_key))
        before = stored(df.sparkSession, location, table) if mode == "append" else None
        if before is not None:
            df = df.join(before.select(*dedupe_key), list(dedupe_key), "left_anti")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if table:
        writer.saveAsTable(location)
    elif mode == "append":
        # Noted before the rows are there, so a reader never misses a column.
        note_schema(df, location)
        write_rows(df, writer, location)
    else:
        write_rows(df, writer, location)
        note_schema(df, location)


def write_rows(df: DataFrame, writer: DataFrameWriter, location: str) -> None:
    """Write to a folder, vectors in two-level lists; lists that may hold nulls need three levels anyway."""
    if any(isinstance(f.dataType, ArrayType) and not f.dataType.containsNull for f in df.schema.fields):
        with held_setting(df.sparkSession, TWO_LEVEL_LISTS, "true"):
            writer.parquet(location)
    else:
        writer.parquet(location)


def noted_schema(spark: SparkSession, location: str) -> StructType | None:
    """The columns of all loads of a folder, in the order they came, as the notes beside its rows say; None without notes.

    A note is one line, written only by a load that brings new columns; Parquet readers skip the notes' folder.
    """
    try:
        notes = [StructType.fromJson(json.loads(r["value"])) for r in spark.read.text(f"{location}/{NOTES}").collect()]
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    fields: dict[str, StructField] = {}
    for note in sorted(notes, key=lambda n: (len(n.fields), n.json())):
        for field in note.fields:
            fields.setdefault(field.name.lower(), field)
    return StructType(list(fields.values())) if fields else None


def note_schema(df: DataFrame, location: str) -> None:
    """Note the columns of `df` beside a folder's rows, after those that are there."""
    spark = df.sparkSession
    known = noted_schema(spark, location)
    if known is None:
        before = _merged(spark, location)
        known = before.schema if before is not None else StructType([])
    have = {f.name.lower() for f in known.fields}
    new = [StructField(f.name, f.dataType) for f in df.schema.fields if f.name.lower() not in have]
    if new or not have:
        line = StructType([*known.fields, *new]).json()
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{location}/{NOTES}")


def stored(spark: SparkSession, location: str, table: bool = False) -> DataFrame | None:
    """What a location already holds, or None."""
    if table:
        return spark.table(location) if spark.catalog.tableExists(location) else None
    schema = noted_schema(spark, location)
    return _merged(spark, location) if schema is None else spark.read.schema(schema).parquet(location)


def _merged(spark: SparkSession, location: str) -> DataFrame | None:
    """A folder without notes: its columns come from the footers of all its files."""
    try:
        return spark.read.option("mergeSchema", True).parquet(location)
    except AnalysisException as failure:
        if failure.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = const.JDBC_BATCH, **options) -> None:
    """Append to a database table; arrays go as JSON text."""
    cells: list[Column] = [
        F.to_json(name).alias(name) if kind.startswith(("array", "struct", "map")) else F.col(name)
        for name, kind in df.dtypes
    ]
    df.select(*cells).write.mode(mode).options(batchsize=batch_size, **options).jdbc(url, table)


def missing_columns(required: Sequence[str], existing: Sequence[str]) -> list[str]:
    known = set(existing)
    return [name for name in required if name not in known]


def evolve_schema(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Both tables as one: columns either lacks are added as nulls, old rows stay."""
    return incoming if existing is None else existing.unionByName(incoming, allowMissingColumns=True)


def align_to(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows with every stored column first, in stored order, then the new ones."""
    have = set(incoming.columns)
    stored = [
        F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in existing.schema.fields
    ]
    return incoming.select(*stored, *[F.col(f"`{n}`") for n in missing_columns(incoming.columns, existing.columns)])


def stamp_load(df: DataFrame, source_file: Column | str | None = None, row_index: Column | str | None = None) -> DataFrame:
    """Provenance and load time: source_file, row_index, created_at, updated_at."""
    stamps = {"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    if source_file is not None:
        stamps["source_file"] = F.lit(source_file) if isinstance(source_file, str) else source_file
    if row_index is not None:
        stamps["row_index"] = F.col(row_index) if isinstance(row_index, str) else row_index
    return df.withColumns(stamps)
