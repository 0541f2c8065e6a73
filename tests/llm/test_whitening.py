import math
from fractions import Fraction

import numpy as np
import pytest

from quillvec.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long"


def residual(matrix, values, vectors):
    """Largest entry of V x - e x, worked out in extended precision, relative to the matrix."""
    a, x = matrix.astype(np.longdouble), vectors.astype(np.longdouble)
    return float(np.abs(a @ x - x * values).max() / np.abs(a).max()), float(np.abs(x.T @ x - np.eye(len(a))).max())


def rotated(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    # Orthogonal to extended precision.
    for _ in range(3):
        q = q @ (3 * np.eye(len(values)) - q.T @ q) / 2
    return (q * np.array(values, dtype=np.longdouble)) @ q.T, q


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.1], [2, 2, 2, 1, 1], [1e6, 1e6 - 1e-4, 1, 1e-6, 0], [1, 1, 1, 1, 1], [0] * 5,
    list(np.linspace(1, 1.0001, 40)), [3 - 1e-7 * i for i in range(10)] + [1] * 10, [1e-30, 1e-31, 0], [4e40, 1e40, 1e38], [7],
])
def test_eigenvectors_to_double_precision(values):
    matrix, q = rotated(values, 1)
    matrix = (matrix + matrix.T) / 2
    found, vectors = w.eigenvectors(matrix)
    assert (np.diff(found) <= 0).all()
    if any(values):
        off, unit = residual(matrix, found, vectors)
        assert off < 1e-15 * len(values) and unit < 2e-15
    # Vectors of values well apart are the ones the matrix was made of.
    for i, v in enumerate(values):
        gap = min((abs(v - u) for j, u in enumerate(values) if j != i), default=1)
        if gap > 1e-10 * max(values):
            mine = vectors[:, list(np.argsort(-np.array(values), kind="stable")).index(i)]
            own = q[:, i].astype(np.float64)
            assert min(np.abs(mine - own).max(), np.abs(mine + own).max()) < 4e-16 * len(values) + 2e-18 * max(values) / gap


def test_float32_alone_is_not_enough():
    matrix, q = rotated([1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.1], 1)
    rough = np.linalg.eigh(matrix.astype(np.float32))[1][:, ::-1]
    assert abs(abs(rough[:, 0] @ q[:, 0].astype(float)) - 1) > 1e-4


def plain(rows):
    """All in exact fractions but for the eigenvectors."""
    kept = [(i, [math.floor(256 * float(c)) + 0 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lists = {tuple(x) for _, x in kept}
    dims = {}
    for x in lists:
        dims[len(x)] = dims.get(len(x), 0) + 1
    d = max(dims, key=lambda k: (dims[k], k))
    lists = [x for x in lists if len(x) == d]
    n, sums = len(lists), [sum(c) for c in zip(*lists)]
    cov = [[sum((x[i] - Fraction(sums[i], n)) * (x[j] - Fraction(sums[j], n)) for x in lists) / n for j in range(d)] for i in range(d)]
    return [(i, x) for i, x in kept if len(x) == d], n, sums, np.array([[float(c) for c in r] for r in cov])


def check(spark, rows, frame):
    kept, n, sums, cov = plain(rows)
    found = frame.collect()
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    c = min(4, len(sums))
    assert len(found) == c * len(kept)
    assert {r["n"] for r in found} == {n} and {r["component"] for r in found} == set(range(1, c + 1))
    deviations = sorted(sum((n * v - s) ** 2 for v, s in zip(x, sums)) for _, x in kept)
    for k in range(c):
        own = [r for r in found if r["component"] == k + 1]
        assert sorted(r["deviation"] for r in own) == deviations
        assert all(abs(r["explained"] - values[k] / np.trace(cov)) < 1e-4 * values[k] / np.trace(cov) for r in own)
        expected = {}
        for i, x in kept:
            expected.setdefault(i, []).append((np.array(x) - np.array([s / n for s in sums])) @ vectors[:, k] / np.sqrt(values[k]))
        signs = [+1, -1]
        for r in own:
            signs = [s for s in signs if any(abs(s * r["whitened"] - e) < 1e-6 for e in expected[r["vec_id"]])]
        assert signs
    assert all(r["identity_error"] < 1e-9 for r in found)


def test_rows_like_plain(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(120, 6)) * [3, 2, 1.5, 1, 0.5, 0.1]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [rows[3], (None, rows[4][1])]
    rows += [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] + [0.0] * 5), (304, [float("inf")] * 6), (305, [1.0, 2.0])]
    rows += [(306, [-0.0, 0.0, -1e-9, 1e-9, 0.001, -0.001])]
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(4)
    check(spark, rows, w.whiten(frame))


def test_query(spark, tmp_path):
    draw = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(draw.normal(size=(80, 8)) * np.arange(1, 9))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    check(spark, rows, w.query(spark, str(tmp_path)))


def test_nothing_varies(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert w.whiten(empty).count() == 0
    assert w.whiten(spark.createDataFrame([(1, None, 1, 1, 1), (2, [], 1, 1, 1)], SCHEMA)).count() == 0
    one = w.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, 1, 1)] * 3, SCHEMA)).collect()
    assert len(one) == 6 and all((r["whitened"], r["explained"], r["identity_error"], r["deviation"]) == (None, None, None, 0) for r in one)
    flat = w.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, 1, 1), (2, [2.0, 2.0], 1, 1, 1)], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"]) for r in flat if r["component"] == 1) == [(1, 1, -1.0), (2, 1, 1.0)]
    assert all(r["whitened"] is None and r["explained"] == 0 for r in flat if r["component"] == 2)


def test_huge_entries(spark):
    rows = [(1, [3e38, 1.0], 1, 1, 1), (2, [-3e38, 2.0], 1, 1, 1), (3, [1e12, 5.0], 1, 1, 1)]
    found = w.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 6 and {r["deviation"] for r in found} == {None}
    wide = [(i, [float(2**20 * i), float(i * i % 7)], 1, 1, 1) for i in range(5)]
    check(spark, [(r[0], r[1]) for r in wide], w.whiten(spark.createDataFrame(wide, SCHEMA)))
