"""Vector column functions (V1-V5, V7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0.0 for null, zero or differently sized vectors."""
    ratio = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(F.size(a) == F.size(b), F.coalesce(ratio, F.lit(0.0))).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def l2_squared(a: Column, b: Column) -> Column:
    def step(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    total = F.aggregate(F.zip_with(a, b, step), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def l2_normalize(v: Column) -> Column:
    """Unit vector as array<float>; a zero vector stays as it is."""

    def scaled(n: Column) -> Column:
        unit = F.transform(v, lambda x: (x.cast("double") / n).cast("float"))
        return F.when(n == 0.0, v.cast("array<float>")).otherwise(unit)

    return bind(norm(v), scaled)


def vector_to_json(v: Column) -> Column:
    return F.to_json(v)


def vector_from_json(text: Column) -> Column:
    """Array from JSON text; null when the text is not an array of numbers."""
    parsed = F.from_json(text, "array<float>")
    return bind(parsed, lambda v: F.when(~F.exists(v, lambda x: x.isNull()), v))


def vector_to_string(v: Column, digits: int = 6) -> Column:
    """`[v1,v2,...]` at fixed precision. Lossy: for export only."""
    cells = F.transform(v, lambda x: F.format_string(f"%.{digits}f", x.cast("double")))
    return F.concat(F.lit("["), F.array_join(cells, ","), F.lit("]"))


def resolve_vector(embedding: Column, vector_json: Column) -> Column:
    """Native vector when there is one, else the decoded JSON text."""
    return F.coalesce(embedding, vector_from_json(vector_json))


def has_embedding(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0)


def dimension_ok(v: Column, dim: int) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))


def require_dimension(v: Column, dim: int) -> Column:
    """The vector itself, or a failed job when its size is not `dim`."""
    message = F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))
    return F.when(v.isNull() | (F.size(v) == dim), v).otherwise(F.raise_error(message).cast("array<float>"))
