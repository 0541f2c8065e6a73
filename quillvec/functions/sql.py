"""The vector functions and the encoder for use in SQL text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillvec.functions.encode import EncoderFactory, hashed_encoder

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS DOUBLE) * cast(y AS DOUBLE)), 0D, (s, p) -> s + p)"
_COSINE = (
    "CASE WHEN size(a) = size(b) THEN coalesce(try_divide("
    + _DOT.format(a="a", b="b")
    + ", sqrt("
    + _DOT.format(a="a", b="a")
    + ") * sqrt("
    + _DOT.format(a="b", b="b")
    + ")), 0D) ELSE 0D END"
)


def register_functions(spark: SparkSession, factory: EncoderFactory | None = None) -> None:
    """Temporary SQL functions cosine_similarity, cosine_distance and generate_embeddings.

    The first two are SQL functions, inlined by the optimizer; the last calls the encoder in Arrow batches.
    """
    pair = "(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity{pair} {_COSINE}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance{pair} 1D - ({_COSINE})")
    factory = factory or hashed_encoder()

    @F.pandas_udf("array<float>")
    def generate_embeddings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in batches:
            filled = texts.map(lambda t: bool(t and t.strip()))
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if filled.any():
                rows = encode(texts[filled].to_numpy(dtype=object))
                out[filled] = pd.Series(list(np.asarray(rows, dtype=np.float32)), index=texts[filled].index)
            yield out

    spark.udf.register("generate_embeddings", generate_embeddings.asNondeterministic())
