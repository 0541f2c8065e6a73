"""Approximate top-k over k-means cells (K16): probe the nearest cells, score their rows exactly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec import constants as const
from quillvec.functions.vector import has_embedding, l2_normalize
from quillvec.operators.scoring import pack_requests
from quillvec.operators.search import (
    BLOCK_FLOATS,
    BLOCK_ROWS,
    BROADCAST_FLOATS,
    BROADCAST_REQUESTS,
    HELD_ROWS,
    REQUEST_BLOCK_FLOATS,
    REQUEST_BLOCK_ROWS,
    _ordered,
    _rank,
    _request_size,
    _scan,
    _scan_side,
    attach,
    block_rows,
    default_requests,
    meet_in_blocks,
    scannable,
)
from quillvec.session import settle


# Rows per cell that shape the centroids, and floats of one product of rows and centroids (64 MB).
TRAIN_ROWS_PER_CELL = 256
PRODUCT_FLOATS = 16_000_000


def train_cells(
    corpus: DataFrame, cells: int, seed: int = 7, max_iter: int = 5, rows_per_cell: int = TRAIN_ROWS_PER_CELL
) -> np.ndarray:
    """Unit centroids, one row per cell, from about `rows_per_cell` rows for each, drawn by a hash of the id.

    The draw only shapes the cells; every corpus row is assigned to one whatever the centroids are.
    """
    rows = corpus.filter(has_embedding(F.col("embedding"))).select("id", "embedding")
    share = min(1.0, cells * rows_per_cell / max(rows.count(), 1))
    # The whole range of the hash, so that any share, however small, draws about as many rows as asked for.
    drawn = rows.filter(F.xxhash64("id", F.lit(seed)) <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))
    # Written, as the algorithm reads it again and again.
    unit = settle(drawn, "training").select(array_to_vector(l2_normalize(F.col("embedding"))).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, initSteps=2).fit(unit)
    centers = np.array(model.clusterCenters(), dtype=np.float64)
    length = np.linalg.norm(centers, axis=1, keepdims=True)
    return (centers / np.where(length == 0.0, 1.0, length)).astype(np.float32)


def _unit_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable row numbers, their matrix); direction is all that matters for the nearest unit centroid."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    rows = np.flatnonzero(sizes == dim)
    starts = np.cumsum(sizes) - sizes
    matrix = flat[starts[rows][:, None] + np.arange(dim)]
    finite = np.isfinite(matrix).all(axis=1)
    return rows[finite], matrix[finite]


def _nearest(matrix: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest centroids of each row, some rows at a time."""
    at_once = max(1, PRODUCT_FLOATS // len(centroids))
    out = np.empty((len(matrix), probes), dtype=np.int32)
    for i in range(0, len(matrix), at_once):
        product = matrix[i : i + at_once] @ centroids.T
        out[i : i + at_once] = (
            product.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-product, axis=1, kind="stable")[:, :probes]
        )
    return out


def nearest_cell(embedding: Column, centroids: np.ndarray) -> Column:
    """Cell of a vector; null for vectors of another dimension."""

    @F.arrow_udf("int")
    def assign(vectors: pa.Array) -> pa.Array:
        cell = np.zeros(len(vectors), dtype=np.int32)
        known = np.zeros(len(vectors), dtype=bool)
        rows, matrix = _unit_matrix(vectors, centroids.shape[1])
        if len(rows):
            cell[rows] = _nearest(matrix, centroids, 1)[:, 0]
            known[rows] = True
        return pa.array(cell, type=pa.int32(), mask=~known)

    return assign.asNondeterministic()(embedding.cast("array<float>"))


def nearest_cells(embedding: Column, centroids: np.ndarray, probes: int) -> Column:
    """The `probes` nearest cells of a vector."""
    probes = min(probes, len(centroids))

    @F.arrow_udf("array<int>")
    def choose(vectors: pa.Array) -> pa.Array:
        out: list[list[int]] = [[] for _ in range(len(vectors))]
        rows, matrix = _unit_matrix(vectors, centroids.shape[1])
        if len(rows):
            best = _nearest(matrix, centroids, probes)
            for row, chosen in zip(rows, best.tolist()):
                out[row] = chosen
        return pa.array(out, type=pa.list_(pa.int32()))

    return choose.asNondeterministic()(embedding.cast("array<float>"))


def assign_cells(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The corpus with its `cell`."""
    return corpus.withColumn("cell", nearest_cell(F.col("embedding"), centroids))


def cluster_by_cell(assigned: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in cell order, ready to be written: a search then skips files and row groups without a probed cell.

    The id hash in the range key lets a cell with a large share of the rows spread over many files.
    """
    count = partitions or int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return assigned.repartitionByRange(count, "cell", F.xxhash64("id")).sortWithinPartitions("cell")


def build_index(corpus: DataFrame, location: str, cells: int, partitions: int | None = None, **training) -> None:
    """Train cells and store the corpus by cell, with its centroids, in a folder that holds no index yet."""
    centroids = train_cells(corpus, cells, **training)
    spark = corpus.sparkSession
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<float>")
    table.coalesce(1).write.parquet(f"{location}/centroids")
    cluster_by_cell(assign_cells(corpus, centroids), partitions).write.parquet(f"{location}/rows")


def open_index(spark: SparkSession, location: str) -> tuple[DataFrame, np.ndarray]:
    """The stored rows with their cells, and the centroids (one row per cell)."""
    rows = spark.read.parquet(f"{location}/centroids").orderBy("cell").collect()
    return spark.read.parquet(f"{location}/rows"), np.array([r["centroid"] for r in rows], dtype=np.float32)


def add_to_index(rows: DataFrame, location: str, partitions: int | None = None) -> None:
    """Append new rows to a stored index; its cells stay as they are."""
    _, centroids = open_index(rows.sparkSession, location)
    cluster_by_cell(assign_cells(rows, centroids), partitions).write.mode("append").parquet(f"{location}/rows")


def search_ann(
    indexed: DataFrame,
    requests: DataFrame,
    centroids: np.ndarray,
    probes: int = 4,
    payload: Sequence[str] = (),
    broadcast_floats: int = BROADCAST_FLOATS,
) -> DataFrame:
    """Approximate `search_batch`: exact scores, but only rows in each request's nearest cells are looked at."""
    asked = default_requests(requests, const.SEARCH_TOP_N, const.SEARCH_THRESHOLD).select(
        "query_id", "query_vec", "top_k", "threshold"
    )
    asked = asked.withColumn("cells", nearest_cells(F.col("query_vec"), centroids, probes))
    count, floats, widest, wanted, _ = _request_size(asked, [])
    few = floats <= broadcast_floats and count <= BROADCAST_REQUESTS and wanted <= HELD_ROWS
    if few and scannable(indexed, -(-count * min(probes, len(centroids)) // len(centroids))):
        table = asked.toArrow()
        probed = sorted({cell for cells in table.column("cells").to_pylist() for cell in cells})
        reached = indexed.filter(F.col("cell").isin(probed)) if len(probed) < len(centroids) else indexed
        packed = pack_requests(table, probes_col="cells")
        partials = _scan(reached.filter(F.col("cell").isNotNull()), packed, "cosine", False, (), "cell")
    else:
        # Written, as the cells are counted before the rows meet.
        partials = _cells_meet(indexed, settle(asked, "probing"), centroids.shape[1])
    ranked = _rank(partials, widest, False).withColumnRenamed("score", "similarity")
    return _ordered(attach(ranked, indexed, payload, wanted), payload, False, "part" in indexed.columns)


def _cells_meet(indexed: DataFrame, asked: DataFrame, dim: int) -> DataFrame:
    """Cells cut into bounded blocks on both sides, so a cell with a third of all rows is many groups."""
    side = _scan_side(indexed, ["cell"]).filter(F.col("cell").isNotNull())
    probing = asked.withColumn("cell", F.explode("cells")).drop("cells")

    def cuts(rows: DataFrame, name: str, size: int) -> DataFrame:
        blocks = F.ceil(F.count("*") / F.lit(size)).cast("int")
        return rows.groupBy("cell").agg(blocks.alias(name))

    # At most one row per cell.
    met = cuts(side, "_nc", block_rows(dim, BLOCK_FLOATS, BLOCK_ROWS)).join(
        cuts(probing, "_nq", block_rows(dim, REQUEST_BLOCK_FLOATS, REQUEST_BLOCK_ROWS)), "cell"
    )
    met = F.broadcast(settle(met, "cuts"))
    pairs = met.agg(F.coalesce(F.sum(F.col("_nc") * F.col("_nq")), F.lit(0))).first()[0]

    def own(key: str, number: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(number)).cast("int")

    def every(number: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    left = side.join(met, "cell")
    left = left.withColumn("_cb", own("id", "_nc")).withColumn("_qb", every("_nq")).drop("_nc", "_nq")
    right = probing.join(met, "cell")
    right = right.withColumn("_qb", own("query_id", "_nq")).withColumn("_cb", every("_nc")).drop("_nc", "_nq")
    return meet_in_blocks(left, right, ["cell", "_qb", "_cb"], pairs, "cosine", False, ())


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact results, how many of them the approximate search found, and their ratio."""
    keys = ["query_id", "id"]
    hit = approximate.select(*keys).withColumn("_hit", F.lit(1))
    return (
        exact.select(*keys)
        .join(hit, keys, "left")
        .agg(F.count("*").alias("exact_rows"), F.count("_hit").alias("found_rows"))
        .withColumn("recall", F.coalesce(F.try_divide("found_rows", "exact_rows"), F.lit(1.0)))
    )
