"""Pages to numbered chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec import constants as const
from quillvec.functions.chunker import chunk_recursive
from quillvec.functions.text import chunk_fixed
from quillvec.operators.clean import nonblank_text
from quillvec.operators.ids import running_total

CHUNKERS = {"recursive": chunk_recursive, "fixed": chunk_fixed}


def chunk_pages(
    pages: DataFrame, method: str = "recursive", size: int = const.CHUNK_SIZE, overlap: int = const.CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk: file_name, page_number, pos within the page, content. A map over pages, no shuffle."""
    chunks = CHUNKERS[method](F.col("text"), size, overlap)
    return pages.select(
        "file_name",
        F.col("page").alias("page_number"),
        F.posexplode(chunks).alias("pos", "content"),
    )


def chunk_metadata(pages: DataFrame, method: str = "recursive", size: int = const.CHUNK_SIZE, overlap: int = const.CHUNK_OVERLAP) -> DataFrame:
    """Chunks with `chunk_index` over the whole run by (file, page, place on the page); blank ones take a number and go.

    Pages are cut once and written with their chunks; only their keys and numbers of chunks are sorted. A page's first
    number meets it where it lies, and its chunks count on from there.
    """
    cut = pages.select("file_name", F.col("page").alias("page_number"), CHUNKERS[method](F.col("text"), size, overlap).alias("chunks"))
    first = running_total(cut, ["file_name", "page_number"], "first", size=F.coalesce(F.size("chunks"), F.lit(0)))
    chunks = first.select("file_name", "page_number", "first", F.posexplode("chunks").alias("pos", "content"))
    numbered = chunks.select("file_name", "page_number", "pos", "content", (F.col("first") + F.col("pos")).alias("chunk_index"))
    return nonblank_text(numbered, "content")
