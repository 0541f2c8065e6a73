"""Text to vector: a pluggable batch encoder and the offline hashed default."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillvec import constants as const
from quillvec.functions.text import not_blank

HASH_DIM = 256
# Rows of a batch that are made dense before they leave the task.
ROWS_AT_ONCE = 512
TOKEN_GAP = r"[ \t\n\r\f]+"

# A factory is called once per task; what it returns maps a batch of texts to a (n, dim) matrix.
EncoderFactory = Callable[[], Callable[[np.ndarray], np.ndarray]]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda t: t != "")


def token_bucket(token: Column, dim: int) -> Column:
    """The first eight hex digits of the token's md5, modulo the dimension."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % F.lit(dim)).cast("int")


def token_buckets(text: Column, dim: int) -> Column:
    return F.transform(tokens(text), lambda t: token_bucket(t, dim))


def _unit_rows(counts: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.square(counts).sum(axis=1, keepdims=True))
    return (counts / np.where(length == 0.0, 1.0, length)).astype(np.float32)


def hashed_vector(text: Column, dim: int = HASH_DIM) -> Column:
    """Deterministic unit vector of token-bucket counts; null for blank text.

    Tokens are hashed inside the JVM; one Arrow call per batch turns bucket lists into dense rows, so a
    document never leaves its partition.
    """

    # Marked non-deterministic here and below so that the optimizer neither repeats the call nor pushes
    # filters on its result beneath it.

    def dense_rows(buckets: pa.Array) -> pa.Array:
        rows = len(buckets)
        owner = np.repeat(np.arange(rows), buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.bincount(owner * dim + flat, minlength=rows * dim).reshape(rows, dim)
        unit = pa.array(_unit_rows(counts.astype(np.float64)).ravel(), type=pa.float32())
        offsets = pa.array(np.arange(0, rows * dim + 1, dim), type=pa.int32())
        return pa.ListArray.from_arrays(offsets, unit)

    @F.arrow_udf(ArrayType(FloatType(), False))
    def densify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for buckets in batches:
            for start in range(0, len(buckets), ROWS_AT_ONCE):
                yield dense_rows(buckets.slice(start, ROWS_AT_ONCE))

    dense = densify.asNondeterministic()(F.when(not_blank(text), token_buckets(text, dim)))
    return F.when(not_blank(text), dense)


def hashed_encoder(dim: int = HASH_DIM) -> EncoderFactory:
    """The same encoding as `hashed_vector`, in the shape of a pluggable encoder."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        gap = re.compile(TOKEN_GAP)

        def encode(texts: np.ndarray) -> np.ndarray:
            counts = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                for token in gap.split((text or "").lower()):
                    if token:
                        counts[row, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
            return _unit_rows(counts)

        return encode

    return make


def vectorize(text: Column, factory: EncoderFactory, batch_size: int = const.ENCODE_BATCH) -> Column:
    """Vector of each text by the encoder, in batches; null for blank text, always aligned with its row."""
    encode = predict_batch_udf(factory, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return F.when(not_blank(text), encode.asNondeterministic()(F.coalesce(text, F.lit(""))))


def vectorize_isolated(
    text: Column,
    factory: EncoderFactory,
    batch_size: int = const.ENCODE_BATCH,
    policy: str = "null",
) -> Column:
    """struct<vector, error>: a failing text gets an empty vector and its error (`null`) or ends the job (`raise`)."""
    if policy not in ("null", "raise"):
        raise ValueError("policy is 'null' or 'raise'")

    def one_by_one(encode: Callable[[np.ndarray], np.ndarray], texts: np.ndarray) -> Iterator[tuple]:
        for text in texts:
            try:
                yield encode(np.array([text], dtype=object))[0], None
            except Exception as failure:
                yield np.empty(0, np.float32), f"{type(failure).__name__}: {failure}"

    def encode_batch(encode: Callable[[np.ndarray], np.ndarray], texts: np.ndarray) -> list[tuple]:
        try:
            return [(row, None) for row in encode(texts)]
        except Exception:
            if policy == "raise":
                raise
            return list(one_by_one(encode, texts))

    @F.pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for batch in batches:
            rows: list[tuple] = [(None, None)] * len(batch)
            wanted = [i for i, text in enumerate(batch) if text is not None]
            for start in range(0, len(wanted), batch_size):
                part = wanted[start : start + batch_size]
                encoded = encode_batch(encode, batch.iloc[part].to_numpy(dtype=object))
                for i, row in zip(part, encoded):
                    rows[i] = row
            yield pd.DataFrame({"vector": [v for v, _ in rows], "error": [e for _, e in rows]})

    return run.asNondeterministic()(F.when(not_blank(text), text))
