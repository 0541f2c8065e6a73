"""Embedding whitening by eigenvectors in mixed precision.

Tasks turn vectors into whole numbers, Spark keeps each distinct one once, and sums and centred products over them are
added up exactly. The driver gets the covariance alone (dimension x dimension). Its eigenvectors are found in float32 and
corrected by the iteration of Ogita and Aishima: a few matrix products in extended precision per step, quadratic
convergence. Where eigenvalues lie closer than the step can tell apart, the small problem of their cluster is solved
after a shift, and the iteration goes on.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import small_batches
from quillvec.session import settle

SCALE = 256
COMPONENTS = 4
STEPS = 24
# Whole numbers are held at these sizes at most, so that they fit 64 bits.
LARGEST = 2.0**62

# --- vectors as whole numbers ----------------------------------------------------------------------


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, lengths, whole numbers one vector after the other): rows without null or non-finite entries."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    lengths[~np.asarray(column.is_valid())] = 0
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = lengths > 0
    good[owner[~np.isfinite(values)]] = False
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * values[good[owner]]), -LARGEST, LARGEST).astype(np.int64)
    return np.flatnonzero(good), lengths[good], x


def packed(x: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Each vector as bytes, the same for equal vectors: the width of a number, then the numbers."""
    ends = np.cumsum(lengths)
    size = np.maximum.reduceat(np.where(x < 0, -x - 1, x), ends - lengths) if len(x) else x
    out = []
    for a, b, most in zip((ends - lengths).tolist(), ends.tolist(), size.tolist()):
        width = 2 if most < 2**15 else 4 if most < 2**31 else 8
        out.append(bytes([width]) + x[a:b].astype(f"<i{width}").tobytes())
    return out


def unpacked(rows: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of one dimension as a matrix of whole numbers."""
    by_width: dict[int, list[bytes]] = {}
    for data in rows.to_pylist():
        by_width.setdefault(data[0], []).append(data[1:])
    parts = [np.frombuffer(b"".join(v), f"<i{w}").astype(np.int64) for w, v in by_width.items()]
    return np.concatenate(parts or [np.zeros(0, dtype=np.int64)]).reshape(-1, dimension)


def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, lengths, x = whole_vectors(batch.column(0))
        yield pa.record_batch([pa.array(packed(x, lengths), pa.binary()), pa.array(lengths, pa.int32())], names=["x", "dimension"])


# --- sums over the fit list ------------------------------------------------------------------------


def sum_batches(dimension: int) -> Callable:
    """Per task and dimension the sums of the numbers' upper and lower halves, so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dimension, dtype=np.int64), np.zeros(dimension, dtype=np.int64)
        for batch in batches:
            x = unpacked(batch.column(0), dimension)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(dimension), pa.int32()), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    return run


def product_batches(center: np.ndarray, dimension: int) -> Callable:
    """Per task the sums of products of centred vectors, a row of the matrix as one row. Whole numbers are exact below 2^53."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            x = (unpacked(batch.column(0), dimension) - center).astype(np.float64)
            total += x.T @ x
        yield matrix_rows(np.arange(dimension), total)

    return run


def matrix_rows(i: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
    return pa.record_batch([pa.array(i, pa.int32()), rows], names=["i", "values"])


def add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one number added up; a task holds one row of the matrix for each of its numbers."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, values in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = values.values.to_numpy()
            sums[i] = sums[i] + v if i in sums else v
    if sums:
        yield matrix_rows(np.array(sorted(sums)), np.array([sums[i] for i in sorted(sums)]))


# --- eigenvectors ----------------------------------------------------------------------------------


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of two or more neighbouring ones of the sorted values that lie no further apart than `gap`."""
    order = np.argsort(-values, kind="stable")
    breaks = np.flatnonzero(np.diff(values[order]) < -gap) + 1
    return [c for c in np.split(order, breaks) if len(c) > 1]


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of a symmetric matrix given in extended precision, to double precision."""
    wide = np.longdouble
    d = len(matrix)
    size = np.abs(matrix).max() if d else 0
    if not size:
        return np.zeros(d), np.eye(d)
    # A power of two, so that float32 holds the matrix and nothing is rounded.
    unit = wide(2.0) ** int(np.floor(np.log2(size)))
    a = matrix.astype(wide) / unit
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    norm = np.linalg.norm(a.astype(np.float64), 2)
    eye, last = np.eye(d, dtype=wide), np.inf
    for _ in range(STEPS):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        gap = 2 * (np.linalg.norm(off.astype(np.float64), 2) + norm * np.linalg.norm(r.astype(np.float64), 2))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > gap
        e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = x + x @ e
        near = clusters(values, gap)
        for group in near:
            own = x[:, group]
            small = own.T @ (a @ own)
            shift = np.trace(small) / len(group)
            turned = np.linalg.eigh(((small + small.T) / 2 - shift * np.eye(len(group), dtype=wide)).astype(np.float64))[1]
            x[:, group] = own @ turned.astype(wide)
        change = float(np.abs(e).max())
        # Done once a step changes nothing that double precision sees, clusters included.
        if change < 2.0**-58 or (change >= last and change < 2.0**-50):
            break
        last = change
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    # One sign for all rows: the largest entry is positive.
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(d)])
    return np.maximum(values * unit, 0).astype(np.float64), (x * sign).astype(np.float64)


# --- the model -------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """n and sums of the fit list, and of each component the vector, the eigenvalue and its share of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of `x` on the components, NaN on those without variance."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return ((x - mean) @ self.vectors) * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - sum)^2, null beyond 64 bits."""
        most = np.abs(x).max(initial=0) * float(self.n) + max(map(abs, self.sums))
        if most**2 * len(self.sums) < 2.0**62:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e < 2**63 else None for e in exact]


def moment_batches(model: Whitening) -> Callable:
    """Per task the sums of whitened rows of the fit list and of their products, as (place, sum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(model.values)
        total = np.zeros(c + c * c)
        for batch in batches:
            w = np.nan_to_num(model.whitened(unpacked(batch.column(0), len(model.sums))))
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    return run


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct whole vectors of `vectors`; None if there is none.

    Vectors that are null, empty or hold null or non-finite entries are left out; of several lengths the one of most
    distinct vectors counts (ties: the greater). Shuffled are distinct vectors, as two bytes a number where they fit.
    """
    spark = vectors.sparkSession
    with small_batches(spark):
        every = settle(vectors.select(vector).mapInArrow(pack_batches, "x binary, dimension int").distinct(), "fit")
        found = every.groupBy("dimension").count().orderBy(F.desc("count"), F.desc("dimension")).first()
        if found is None:
            return None
        dimension, n = found["dimension"], found["count"]
        x = every.where(F.col("dimension") == dimension).select("x")
        halves = x.mapInArrow(sum_batches(dimension), "i int, high long, low long").groupBy("i").agg(
            F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")
        )
        sums = [int(r["high"]) * 2**32 + int(r["low"]) for r in halves.orderBy("i").collect()]
        # The whole number nearest to the mean: centred vectors stay whole, what is left of the mean is at most a half.
        center = [(2 * s + n) // (2 * n) for s in sums]
        rest = np.array([np.longdouble(s - n * c) / n for s, c in zip(sums, center)])
        rows = x.mapInArrow(product_batches(np.array(center, dtype=np.int64), dimension), "i int, values array<double>")
        added = rows.repartition("i").mapInArrow(add_rows, "i int, values array<double>").collect()
        products = np.array([r["values"] for r in sorted(added, key=lambda r: r["i"])], dtype=np.longdouble)
        covariance = products / n - np.outer(rest, rest)
        values, columns = eigenvectors((covariance + covariance.T) / 2)
        trace = float(np.trace(covariance))
        values = np.where(values > trace * dimension * 2.0**-50, values, 0.0)[:components]
        model = Whitening(n, sums, np.ascontiguousarray(columns[:, :components]), values, [v / trace if trace > 0 else None for v in values.tolist()])
        moments = x.mapInArrow(moment_batches(model), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    total = np.array([r["v"] for r in moments]) / n
    c = len(values)
    error = np.abs(total[c:].reshape(c, c) - np.outer(total[:c], total[:c]) - np.eye(c))[np.ix_(values > 0, values > 0)]
    model.identity_error = float(error.max()) if error.size else None
    return model


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten_batches(model: Whitening) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, c = len(model.sums), len(model.values)
        for batch in batches:
            kept, lengths, x = whole_vectors(batch.column(1))
            fits = lengths == d
            x = x[np.repeat(fits, lengths)].reshape(-1, d)
            kept = np.repeat(kept[fits], c)
            w, deviations = model.whitened(x).ravel(), model.deviations(x)
            m = len(kept)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(kept)), pa.array(np.tile(np.arange(1, c + 1), len(x)), pa.int32()),
                    pa.array(np.full(m, model.n), pa.int64()), pa.array([v for v in deviations for _ in range(c)], pa.int64()),
                    pa.array(w, pa.float64(), from_pandas=True), pa.array(model.explained * len(x), pa.float64()),
                    pa.array([model.identity_error] * m, pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every row of `vectors` that `fit` does not leave out, on each of the first components.

    Entries c become floor(256 c) (held within 2^62). `deviation` is exact, null beyond 64 bits; on a component without
    variance `whitened` is null. `explained` is null if nothing varies, and so is `identity_error`. A row without id is
    kept; repeated rows are returned as often; other columns are ignored; no rows give no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    model = fit(rows, "vector", components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    return rows.mapInArrow(whiten_batches(model), WHITENED)


def query(spark, sf: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
