"""Catalogue, time, coverage and load statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec import constants as const
from quillvec.functions.vector import has_embedding, vector_from_json


def product_statistics(products: DataFrame, category: str | None = None) -> DataFrame:
    """One row of catalogue totals; `category` restricts it, None does not."""
    if category is not None:
        products = products.filter(F.col("category") == category)
    price, stock = F.col("price"), F.col("stock_quantity")
    return products.agg(
        F.count("*").alias("total_products"),
        F.countDistinct("category").alias("total_categories"),
        F.sum(price).alias("total_value"),
        F.avg(price.cast("double")).alias("average_price"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.sum(stock.cast("long")).alias("total_stock"),
        F.avg(stock.cast("double")).alias("average_stock"),
    )


def stats_by_category(rows: DataFrame, category: str, amount: str) -> DataFrame:
    value = F.col(amount)
    return rows.groupBy(F.col(category).alias("category")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value.cast("double")).alias("average")
    )


def stats_by_day(rows: DataFrame, when: str, amount: str) -> DataFrame:
    """Rows and amount per calendar day, newest first; rows without a time are left out."""
    known = rows.filter(F.col(when).isNotNull())
    daily = known.groupBy(F.to_date(when).alias("day")).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))
    return newest_first(daily, "day")


def stats_by_month(rows: DataFrame, when: str, amount: str) -> DataFrame:
    known = rows.filter(F.col(when).isNotNull())
    monthly = known.groupBy(F.year(when).alias("year"), F.month(when).alias("month")).agg(
        F.count("*").alias("n"), F.sum(amount).alias("total")
    )
    return newest_first(monthly, "year", "month")


def newest_first(rows: DataFrame, *keys: str, tie: str | None = None) -> DataFrame:
    order = [F.desc(key) for key in keys]
    return rows.orderBy(*order, tie) if tie else rows.orderBy(*order)


def embedding_coverage(tables: dict[str, DataFrame], dim: int) -> DataFrame:
    """Per table: rows, rows with a vector in either form, without any, of another dimension, and readiness.

    `tables` hold an `embedding` array and may hold a `vector_json` text. A row counts by its resolved vector: the
    array if it has elements, else what the text decodes to. Text that does not decode, and empty vectors, are none.
    """
    audit: DataFrame | None = None
    for name, rows in tables.items():
        json = F.col("vector_json") if "vector_json" in rows.columns else F.lit(None).cast("string")
        own = has_embedding(F.col("embedding"))
        sized = rows.select(
            own.alias("own"),
            F.when(own, F.size("embedding")).otherwise(F.size(vector_from_json(json))).alias("n"),
        ).select(F.coalesce("own", F.lit(False)).alias("own"), F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("n"))
        row = sized.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("total_rows"),
            F.count_if(F.col("own")).alias("with_vector"),
            F.count_if(~F.col("own") & (F.col("n") > 0)).alias("with_json"),
            F.count_if(F.col("n") == 0).alias("without_vector"),
            F.count_if((F.col("n") > 0) & (F.col("n") != dim)).alias("wrong_dimension"),
        )
        audit = row if audit is None else audit.unionByName(row)
    usable = F.col("with_vector") + F.col("with_json") - F.col("wrong_dimension")
    return audit.withColumns(
        {
            "ready": F.col("total_rows") > 0,
            "warning": F.when(usable <= 0, F.lit(const.NO_VECTOR_WARNING)),
        }
    )


def chunk_load_summary(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: pages read, chunks stored, files among them, and a status that warns on no input."""
    read = pages.agg(F.count("*").alias("total_documents"))
    stored = chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("file_name").alias("total_files"))
    empty = F.col("total_documents") == 0
    # Both sides are single aggregate rows.
    return (
        read.withColumn("_one", F.lit(1))
        .join(stored.withColumn("_one", F.lit(1)), "_one")
        .drop("_one")
        .withColumns(
            {
                "status": F.when(empty, "warning").otherwise("success"),
                "message": F.when(empty, F.lit(const.EMPTY_INPUT_MESSAGE)),
            }
        )
    )


def loaded_files(chunks: DataFrame) -> DataFrame:
    """The distinct files of a load, as rows: the list may be long."""
    return chunks.select("file_name").distinct()


def table_load_summary(
    read: DataFrame, kept: DataFrame, text: Sequence[str], numeric: Sequence[str], datetime: Sequence[str],
    ignored: Sequence[str] = (),
) -> DataFrame:
    """One row: rows read and kept, the column roles, whether vectors were made, and the status.

    A sheet without a single column left by the cleaning held no rows, which is a warning.
    """
    before = read.agg(F.count("*").alias("total_rows")).withColumn("_one", F.lit(1))
    after = kept.agg(F.count("*").alias("rows_imported")).withColumn("_one", F.lit(1))
    empty = F.lit(not (text or numeric or datetime or ignored))

    def names(columns: Sequence[str]):
        return F.array(*[F.lit(c) for c in columns]).cast("array<string>")

    return before.join(after, "_one").drop("_one").withColumns(
        {
            "status": F.when(empty, "warning").otherwise("success"),
            "message": F.when(empty, F.lit(const.EMPTY_INPUT_MESSAGE)),
            "text_columns": names(text),
            "numeric_columns": names(numeric),
            "datetime_columns": names(datetime),
            "ignored_columns": names(ignored),
            "has_embeddings": F.lit(len(text) > 0),
        }
    )


def batch_load_summary(results: DataFrame) -> DataFrame:
    """One row over per-file results (file, status, error, rows_imported)."""
    return results.agg(
        F.count("*").alias("files_processed"),
        F.count_if(F.col("status") == "success").alias("files_success"),
        F.count_if(F.col("status") == "warning").alias("files_empty"),
        F.count_if(F.col("status") == "error").alias("files_failed"),
        F.coalesce(F.sum("rows_imported"), F.lit(0)).alias("rows_imported"),
    ).withColumn("status", F.lit("completed"))


def verify_load(source: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """One row: rows in the source, rows loaded, source keys that did not arrive."""
    # One aggregation on the key replaces a count and an anti join: both tables are read once.
    sides = source.select(F.col(key).alias("k"), F.lit(1).alias("s"), F.lit(0).alias("l")).unionByName(
        loaded.select(F.col(key).alias("k"), F.lit(0).alias("s"), F.lit(1).alias("l"))
    )
    by_key = sides.groupBy("k").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    return by_key.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("loaded_rows"),
        F.count_if((F.col("s") > 0) & (F.col("l") == 0)).alias("missing_keys"),
    ).withColumn("complete", (F.col("missing_keys") == 0) & (F.col("source_rows") == F.col("loaded_rows")))
