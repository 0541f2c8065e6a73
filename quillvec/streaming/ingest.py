"""Incremental ingest: only files not seen before are chunked, encoded and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillvec.operators.chunks import chunk_pages
from quillvec.operators.clean import nonblank_text
from quillvec.plans.load import hashed
from quillvec.session import held_setting
from quillvec.sources.readers import as_pages

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
STATE_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def corpus_of_pages(
    pages: DataFrame, encode: Callable[[Column], Column] | None = None, method: str = "recursive", **sizes
) -> DataFrame:
    """Row-wise corpus, the same for batch and stream: ids are hashes of (file, page, pos), not running numbers."""
    encode = encode or hashed()
    chunks = nonblank_text(chunk_pages(pages, method, **sizes), "content")
    return chunks.select(
        F.xxhash64("file_name", "page_number", "pos").alias("id"),
        "content",
        encode(F.col("content")).alias("embedding"),
        "file_name",
        "page_number",
        F.col("pos").alias("chunk_index"),
    )


def ingest_incremental(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    checkpoint_dir: str,
    schema: StructType | str,
    fmt: str = "parquet",
    columns: tuple[str, str, str] = ("source", "page", "text"),
    max_files_per_trigger: int = 1000,
    partitions: int | None = None,
    skip_stored: bool = True,
    **options,
) -> StreamingQuery:
    """Start a run over all files that arrived since the last one and stop when they are stored.

    A page that arrives again, with the same source, number and text, is left out: the stream keeps a 128-bit key of every
    page it took in, in state on disk that is cut by key and read key by key, so no batch reads what is stored. A page
    whose text changed is taken in once more. `skip_stored=False` keeps no state and takes in every arrival.

    The file sink records its commits, so a run that died is completed, not repeated. `partitions` spreads the
    rows of each batch over that many tasks, for the case of few and large files.
    """
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .format(fmt)
        .load(source_dir)
    )
    if partitions:
        stream = stream.repartition(partitions)
    pages = as_pages(stream, *columns)
    if skip_stored:
        # Null and empty differ, and no two cells run into each other.
        cells = F.to_json(F.struct("source", "page", "text"))
        pages = pages.withColumn("_key", F.unhex(F.md5(cells))).dropDuplicates(["_key"]).drop("_key")
    with held_setting(spark, STATE_STORE, STATE_ON_DISK):
        return (
            corpus_of_pages(pages, **options).writeStream.format("parquet")
            .option("checkpointLocation", checkpoint_dir)
            .outputMode("append")
            .trigger(availableNow=True)
            .start(target_dir)
        )
