"""Composite loads: page text, sheets and catalogues to corpora."""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.functions.encode import HASH_DIM, hashed_vector
from quillvec.functions.text import combined_text, full_text_context, table_name_from_file
from quillvec.functions.vector import has_embedding, vector_to_json
from quillvec.operators import ann, clean, stats
from quillvec.operators.chunks import chunk_metadata
from quillvec.operators.ids import assign_ids, next_id
from quillvec.session import OPEN_FILES, held_setting, settle
from quillvec.sources.readers import as_products, list_table_files, narrow_types, read_records
from quillvec.sources.sinks import align_to, append_corpus, stamp_load, stored

Encoder = Callable[[Column], Column]


def hashed(dim: int = HASH_DIM) -> Encoder:
    return lambda text: hashed_vector(text, dim)


def chunk_corpus(
    pages: DataFrame,
    encode: Encoder | None = None,
    method: str = "recursive",
    first_id: int = 1,
    json_copy: bool = False,
    **sizes,
) -> DataFrame:
    """Pages to corpus rows: chunk, number, drop blanks, encode."""
    encode = encode or hashed()
    chunks = chunk_metadata(pages, method, **sizes)
    vectors = chunks.withColumn("embedding", encode(F.col("content")))
    rows = vectors.select(
        (F.col("chunk_index") + first_id).alias("id"),
        "content",
        "embedding",
        "file_name",
        "page_number",
        "chunk_index",
    )
    return _with_json(rows) if json_copy else rows


def _with_json(rows: DataFrame) -> DataFrame:
    """The vector as JSON text too, for readers without arrays; several times the size of the array."""
    return rows.withColumn("vector_json", vector_to_json(F.col("embedding")))


def _first_id(spark: SparkSession, location: str, mode: str) -> int:
    """Ids go on from the largest one stored."""
    return next_id(stored(spark, location)) if mode == "append" else 1


# Rows that a cell of a new index holds, about.
CELL_ROWS = 4096


def feed_index(location: str, index: str, first_id: int, spark: SparkSession, cells: int | None = None) -> None:
    """Bring the rows of a corpus from `first_id` on into its approximate index, which the first load builds.

    A load without a row to index leaves no index.
    """
    rows = spark.read.parquet(location).filter(F.col("id") >= first_id)
    if stored(spark, f"{index}/rows") is not None:
        ann.add_to_index(rows, index)
        return
    usable = rows.filter(has_embedding(F.col("embedding"))).count()
    if usable:
        ann.build_index(rows, index, cells or max(1, -(-usable // CELL_ROWS)))


def load_chunks(
    pages: DataFrame, location: str, mode: str = "append", index: str | None = None, cells: int | None = None, **options
) -> DataFrame:
    """Run `chunk_corpus` into a Parquet corpus and return the one-row summary of this load.

    With `index`, a folder, the load's rows also go to the approximate index there (see `feed_index`).
    """
    first = _first_id(pages.sparkSession, location, mode)
    corpus = chunk_corpus(pages, first_id=first, **options)
    append_corpus(stamp_load(corpus), location, mode)
    if index:
        feed_index(location, index, first, pages.sparkSession, cells)
    # The numbered chunks are settled, so this reads their file names and does not encode again.
    return stats.chunk_load_summary(pages, corpus)


@dataclass
class LoadedTable:
    """A prepared sheet: rows to store, rows as read, and the column roles."""

    rows: DataFrame
    read: DataFrame
    roles: clean.Roles

    def summary(self) -> DataFrame:
        r = self.roles
        return stats.table_load_summary(self.read, self.rows, r.text, r.numeric, r.datetime, r.ignored)


PROVENANCE = ["source_file", "row_index"]


def clean_sheet(rows: DataFrame) -> DataFrame:
    """Drop empty and sparse rows, then empty columns, then repair the names; provenance columns stay."""
    cells = [c for c in rows.columns if c not in PROVENANCE]
    kept = clean.drop_sparse_rows(clean.drop_empty_rows(rows, cells), cells)
    filled = clean.filled_columns(kept, cells)
    named = clean.normalized_names(filled)
    return kept.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(filled, named)], *PROVENANCE)


def table_corpus(
    rows: DataFrame,
    encode: Encoder | None = None,
    keep_short: bool = False,
    json_copy: bool = False,
    first_id: int = 1,
) -> LoadedTable:
    """A sheet (with source_file and row_index) to stored rows, numbered in sheet order.

    Text and vector are computed in the row they belong to; a row without text keeps a null vector.
    """
    encode = encode or hashed()
    sheet = clean_sheet(rows)
    roles = clean.infer_column_roles(sheet, "row_index", skip=PROVENANCE, keep_short=keep_short)
    dense = clean.drop_low_density(clean.coerce_by_role(sheet, roles, PROVENANCE), roles.data)
    if roles.data:
        dense = assign_ids(dense, PROVENANCE, "id", first_id)
    text = F.nullif(combined_text(roles.text), F.lit(""))
    combined = dense.withColumn("combined_text", text)
    vector = encode(F.col("combined_text")) if roles.text else F.lit(None).cast("array<float>")
    kept = combined.withColumn("embedding", vector)
    return LoadedTable(_with_json(kept) if json_copy else kept, rows, roles)


def load_table(rows: DataFrame, location: str, mode: str = "append", **options) -> DataFrame:
    """Load a sheet into a Parquet table and return its one-row summary.

    A table keeps the columns and types of its first load. New columns are added; a cell that does not fit its
    column's type is stored in `unfit_cells` (column name to text) of its row, and the column is null there.
    """
    before = stored(rows.sparkSession, location) if mode == "append" else None
    loaded = table_corpus(rows, first_id=next_id(before) if before is not None else 1, **options)
    if loaded.roles.data:
        append_corpus(stamp_load(fit_to(loaded.rows, before)), location, mode)
    return loaded.summary()


def fit_to(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """Rows with the types that the stored table has, names compared without case; what does not fit goes to `unfit_cells`."""
    if before is None:
        return rows.withColumn("unfit_cells", F.lit(None).cast("map<string,string>"))
    stored_types = {f.name.lower(): f for f in before.schema.fields}
    columns, unfit = [], []
    for f in rows.schema.fields:
        cell, known = F.col("`" + f.name.replace("`", "``") + "`"), stored_types.get(f.name.lower())
        if known is None or known.dataType == f.dataType:
            columns.append(cell.alias(known.name if known is not None else f.name))
            continue
        fitted = cell.try_cast(known.dataType)
        columns.append(fitted.alias(known.name))
        lost = F.when(cell.isNotNull() & fitted.isNull(), cell.cast("string"))
        unfit.append(F.struct(F.lit(known.name).alias("key"), lost.alias("value")))
    kept = F.map_from_entries(F.filter(F.array(*unfit), lambda e: e["value"].isNotNull())) if unfit else F.lit(None)
    return align_to(rows.select(*columns, kept.cast("map<string,string>").alias("unfit_cells")), before.drop("created_at", "updated_at"))


def load_table_files(
    spark: SparkSession, directory: str, target: str, prefix: str | None = None, header_row: int = 0
) -> DataFrame:
    """Load all CSV files of a directory tree into tables of their own; one result row per file.

    Files with the same header line are one DataFrame: their columns are typed and judged together, and their rows
    are written to `<target>/<header key>` by `table_name`, each table with its own ids. So there are as many loads as
    headers, not as files; a header that fails is reported for its files and the others go on. Quoted cells may hold
    line breaks. Returns source_file (the path), file, table_name, status, error, rows_imported, location.
    """
    files = list_table_files(spark, directory, "csv", prefix)
    lines = settle(read_records(spark, directory), "records")
    heads = settle(
        lines.filter(F.col("row_index") == header_row).select("source_file", F.col("line").alias("header")).withColumn(
            "key", F.substring(F.md5("header"), 1, 12)
        ),
        "headers",
    )
    # One row per file: the lines stay where they are.
    below = lines.filter(F.col("row_index") > header_row).join(F.broadcast(heads.drop("header")), "source_file")
    results = []
    # One row per header.
    for head in heads.groupBy("key").agg(F.first("header").alias("header")).orderBy("key").collect():
        rows = csv_rows(below.filter(F.col("key") == head["key"]), head["header"], header_row)
        of_head = heads.filter(F.col("key") == head["key"]).select("source_file")
        location = f"{target}/{head['key']}"
        try:
            counts, failure = _load_group(rows, location, prefix), None
        except Exception as raised:
            counts, failure = None, str(raised)
        none = F.lit(0).cast("long")
        done = of_head.join(counts, "source_file", "left") if counts is not None else of_head.withColumns({"rows_read": none, "rows_imported": none})
        status = F.lit("error") if failure else F.when(F.coalesce("rows_read", none) == 0, "warning").otherwise("success")
        results.append(done.select(
            "source_file", status.alias("status"), F.lit(failure).cast("string").alias("error"),
            F.coalesce("rows_imported", none).alias("rows_imported"), F.lit(location).alias("location"),
        ))
    empty = spark.createDataFrame([], "source_file string, status string, error string, rows_imported long, location string")
    found = reduce(lambda x, y: x.unionByName(y), results, empty)
    return files.select("source_file", "file", "table_name").join(found, "source_file", "left").select(
        "source_file", "file", "table_name", F.coalesce("status", F.lit("warning")).alias("status"), "error",
        F.coalesce("rows_imported", F.lit(0)).cast("long").alias("rows_imported"), "location",
    )


def csv_rows(lines: DataFrame, header: str, header_row: int) -> DataFrame:
    """Typed cells, source_file and row_index of CSV lines below a common header."""
    names = clean.normalized_names(next(csv.reader([header])))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = lines.select(
        F.from_csv("line", schema, {"escape": '"'}).alias("cells"), "source_file", (F.col("row_index") - header_row - 1).alias("row_index")
    )
    return narrow_types(parsed.select("cells.*", "source_file", "row_index"), names)


def _load_group(rows: DataFrame, location: str, prefix: str | None) -> DataFrame:
    """Load files of one header; (source_file, rows_read, rows_imported)."""
    rows = settle(rows, "sheet")
    before = stored(rows.sparkSession, location)
    loaded = table_corpus(rows)
    read = rows.groupBy("source_file").agg(F.count("*").alias("rows_read"))
    if not loaded.roles.data:
        return read.withColumn("rows_imported", F.lit(0).cast("long"))
    named = loaded.rows.withColumn("table_name", table_name_from_file(F.url_decode("source_file"), prefix))
    # One row per table: where its ids begin in this load, and what it holds already.
    firsts = named.groupBy("table_name").agg(F.min("id").alias("_first"))
    last = before.groupBy("table_name").agg(F.max("id").alias("_last")) if before is not None else None
    firsts = firsts.join(last, "table_name", "left") if last is not None else firsts.withColumn("_last", F.lit(0))
    # Joined by shuffle, a table's rows would meet in one task.
    numbered = named.join(F.broadcast(firsts), "table_name").withColumn("id", F.col("id") - F.col("_first") + F.coalesce("_last", F.lit(0)) + 1)
    kept = fit_to(numbered.drop("_first", "_last"), before)
    # A task keeps the files of its tables open instead of sorting its rows by table.
    with held_setting(rows.sparkSession, OPEN_FILES, "64"):
        append_corpus(stamp_load(kept), location, partition_by=["table_name"])
    imported = loaded.rows.groupBy("source_file").agg(F.count("*").alias("rows_imported"))
    return settle(read.join(imported, "source_file", "left"), "counts")


def product_corpus(rows: DataFrame, encode: Encoder | None = None, first_id: int = 1) -> DataFrame:
    """Untyped catalogue cells to numbered products with context text and vector; rows without a vector drop out."""
    encode = encode or hashed()
    products = assign_ids(as_products(rows), ["ProductId"], "id", first_id)
    context = full_text_context(
        F.col("ProductName"), F.col("Category"), F.col("Description"), F.col("Price").cast("decimal(18,2)")
    )
    described = products.withColumn("full_text_context", context)
    vectors = described.withColumn("embedding", encode(F.col("full_text_context")))
    return vectors.filter(has_embedding(F.col("embedding"))).select(
        "id",
        F.col("ProductId").alias("product_id"),
        F.col("ProductName").alias("product_name"),
        F.col("Category").alias("category"),
        F.col("Description").alias("description"),
        F.col("Price").alias("price"),
        F.col("StockQuantity").alias("stock_quantity"),
        F.col("LastUpdated").alias("last_updated"),
        "full_text_context",
        "embedding",
    )


def load_products(
    rows: DataFrame, location: str, mode: str = "append", encode: Encoder | None = None, index: str | None = None, cells: int | None = None
) -> DataFrame:
    """Run `product_corpus` into Parquet and return the one-row check of source against target.

    With `index`, a folder, the load's rows also go to the approximate index there (see `feed_index`).
    """
    spark = rows.sparkSession
    first = _first_id(spark, location, mode)
    append_corpus(stamp_load(product_corpus(rows, encode, first)), location, mode)
    if index:
        feed_index(location, index, first, spark, cells)
    source = as_products(rows).withColumnRenamed("ProductId", "product_id")
    # Rows of earlier loads have smaller ids.
    return stats.verify_load(source, spark.read.parquet(location).filter(F.col("id") >= first), "product_id")
