"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.llm.common import documents, small_batches
from quillvec.llm.near_dup import chosen
from quillvec.llm.tasks import mixed, odd_numbers
from quillvec.session import settle

# The model is fitted on at most this many rows of each language, the first in a seeded order. All languages are learnt.
LANGUAGE_ROWS = 8_000
# The matrix is broadcast and scored in blocks of this many languages, LANGUAGE_BLOCK * 2^HASH_BITS floats each (64 MB).
LANGUAGE_BLOCK = 256
HASH_BITS = 16
GRAMS = [1, 2, 3]
SMOOTHING = 0.5
# Texts are scored in batches of about this many letters.
BATCH_LETTERS = 500_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def plain(text: str | None) -> str:
    """The words of letters of a text, lower-cased, one space apart; empty if it has no letter."""
    found = " ".join(LETTERS.findall((text or "").lower()))
    return found if any(map(str.isalpha, found)) else ""


def gram_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and where each text's begin.

    A text counts its n-grams from a space before it on; those of its last letters reach into spaces behind it.
    """
    longest = max(GRAMS)
    joined = "".join(" " + t + " " * (longest - 1) for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + longest - 1)[:-1]])
    inside = np.arange(lengths.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    buckets = np.empty((len(inside), len(GRAMS)), dtype=np.int64)
    for column, n in enumerate(GRAMS):
        factors = odd_numbers(n, 61 + n)
        value = sum(codes[inside + k] * factors[k] for k in range(n))
        buckets[:, column] = mixed(value) >> np.uint64(64 - HASH_BITS)
    return buckets.reshape(-1), np.concatenate([[0], np.cumsum(lengths)[:-1]]) * len(GRAMS)


def text_groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BATCH_LETTERS letters, a longer text alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_LETTERS:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if texts[first:]:
        yield first, texts[first:]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each (language, bucket) pair that occurs, one batch of rows for each batch of texts."""
    for batch in batches:
        at = batch.column("language").to_numpy().astype(np.int64)
        texts = [plain(t) for t in batch.column("text").to_pylist()]
        for first, group in text_groups(texts):
            buckets, starts = gram_batch(group)
            sizes = np.diff(np.append(starts, len(buckets)))
            pairs, counts = np.unique(np.repeat(at[first : first + len(group)], sizes) << HASH_BITS | buckets, return_counts=True)
            yield pa.record_batch(
                [pa.array(pairs >> HASH_BITS, pa.int32()), pa.array(pairs & ((1 << HASH_BITS) - 1), pa.int32()), pa.array(counts, pa.int64())],
                names=["language", "bucket", "n"],
            )


def score_batches(matrix, prior: np.ndarray, first_language: int) -> Callable:
    """`matrix` is the broadcast (bucket, language) table of log-probabilities of a block of languages.

    Adds `best`, the likeliest language of the block (the first of equal ones), `top`, its log-likelihood, and `rest`,
    the sum of exp(log-likelihood - top) over the block. A text without letters has no language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = matrix.value
        for batch in batches:
            texts = [plain(t) for t in batch.column("text").to_pylist()]
            sums = np.empty((len(texts), len(prior)))
            for first, group in text_groups(texts):
                buckets, starts = gram_batch(group)
                # Repeated n-grams of a text count each time. A few columns at a time keep the gathered rows small.
                for c in range(0, len(prior), 8):
                    part = np.add.reduceat(table[:, c : c + 8][buckets], starts, axis=0, dtype=np.float64)
                    sums[first : first + len(group), c : c + 8] = part
            sums += prior
            known = np.array([bool(t) for t in texts], dtype=bool)
            best = sums.argmax(axis=1) if len(texts) else np.zeros(0, dtype=int)
            top = sums.max(axis=1) if len(texts) else np.zeros(0)
            rest = np.exp(sums - top[:, None]).sum(axis=1)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(best + first_language, pa.int32(), mask=~known),
                    pa.array(top, pa.float64()),
                    pa.array(rest, pa.float64()),
                    batch.column("row"),
                ],
                names=["doc_id", "best", "top", "rest", "row"],
            )

    return run


class Model(NamedTuple):
    """Languages in order of name, their log shares, what a bucket has that a language never showed, and the others.

    `pairs` has a row for every (language, bucket) that the sample shows: its log-probability above the floor.
    """

    names: list[str]
    prior: np.ndarray
    floor: np.ndarray
    pairs: pa.Table

    def matrix(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The (bucket, language) log-probabilities of the languages from `first` to `end`."""
        floor = self.floor[first:end]
        table = np.tile(floor.astype(np.float32), (1 << HASH_BITS, 1))
        language = self.pairs["language"].to_numpy()
        here = (language >= first) & (language < first + len(floor))
        language = language[here] - first
        table[self.pairs["bucket"].to_numpy()[here], language] = (floor[language] + self.pairs["above"].to_numpy()[here]).astype(np.float32)
        return table


def train(docs: DataFrame, keep: Column) -> Model:
    """The model of all languages of the rows that `keep`.

    Rows without doc_id, lang or text teach nothing; repeated rows count as often as they are there, and a language
    whose rows share their draw keeps the smaller doc_id first. Counts are kept where they occur only, so what the
    driver holds grows with the languages' own n-grams, at most LANGUAGE_ROWS texts each.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & keep)
    rows = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()
    names = sorted(r["lang"] for r in rows)
    if not names:
        return Model([], np.zeros(0), np.zeros(0), pa.table({"language": [], "bucket": [], "above": []}))
    sizes = {r["lang"]: r["rows"] for r in rows}
    # A language's draw is thinned by its share first, so that no task sorts a whole language.
    draws = docs.sparkSession.createDataFrame(
        [(n, i, min(1.0, 1.5 * LANGUAGE_ROWS / sizes[n])) for i, n in enumerate(names)], "lang string, language int, share double"
    )
    draw = F.xxhash64("doc_id", F.lit(5))
    thin = labelled.select("doc_id", "lang", draw.alias("draw")).join(F.broadcast(draws), "lang").where(
        F.col("draw").cast("double") < (F.col("share") * 2 - 1) * F.lit(2.0**63)
    )
    first = F.row_number().over(Window.partitionBy("language").orderBy("draw", "doc_id"))
    sample = settle(thin.withColumn("place", first).where(F.col("place") <= LANGUAGE_ROWS).select("doc_id", "lang", "language"), "sample")
    texts = chosen(labelled.select("doc_id", "lang", "text"), sample.select("doc_id"), "doc_id")
    placed = texts.join(F.broadcast(draws.select("lang", "language")), "lang").select("language", "text")
    with small_batches(docs.sparkSession):
        found = settle(
            placed.mapInArrow(count_batches, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")),
            "counts",
        )
    buckets = 1 << HASH_BITS
    totals = {r["language"]: r["n"] for r in found.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    floor = np.log(SMOOTHING) - np.log(np.array([totals.get(i, 0) + SMOOTHING * buckets for i in range(len(names))]))
    above = (F.log(F.col("n") + SMOOTHING) - math.log(SMOOTHING)).cast("float")
    share = np.array([sizes[n] for n in names], dtype=np.float64)
    return Model(names, np.log(share / share.sum()), floor, found.select("language", "bucket", above.alias("above")).toArrow())


def identify(docs: DataFrame, model: Model, block: int = LANGUAGE_BLOCK) -> DataFrame:
    """doc_id, lang_pred and score of every row of `docs` (doc_id, text).

    score is the posterior of the language. A null text and one without letters are `und` with score 0, and so is
    every row if no language was learnt. Of equally likely languages the first by name is taken. Languages are scored
    `block` at a time, and the blocks' best and sums are put together by row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = model.names
    if not names:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    firsts = range(0, len(names), block)
    if len(firsts) > 1:
        # Rows are told apart by a number that is written down, so that all blocks see the same.
        rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    else:
        rows = rows.withColumn("row", F.lit(0).cast("long"))
    scored = []
    with small_batches(spark):
        for first in firsts:
            shared = spark.sparkContext.broadcast(model.matrix(first, first + block))
            run = score_batches(shared, model.prior[first : first + block], first)
            scored.append(settle(rows.mapInArrow(run, "doc_id long, best int, top double, rest double, row long"), "languages"))
            shared.unpersist()
    found = scored[0]
    if len(scored) > 1:
        together = reduce(DataFrame.unionByName, scored)
        tops = together.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.min(F.struct((-F.col("top")).alias("below"), "best")).alias("least"),
            F.collect_list(F.struct("top", "rest")).alias("parts"),
        )
        top = -F.col("least.below")
        rest = F.aggregate("parts", F.lit(0.0), lambda total, p: total + p["rest"] * F.exp(p["top"] - top))
        found = tops.select("doc_id", F.col("least.best").alias("best"), rest.alias("rest"))
    named = spark.createDataFrame(list(enumerate(names)), "best int, name string")
    # One row a language.
    return found.join(F.broadcast(named), "best", "left").select(
        "doc_id", F.coalesce("name", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("best").isNull(), F.lit(0.0)).otherwise(1 / F.col("rest")).alias("score"),
    )


def held_out() -> Column:
    """The rows whose language is not learnt."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def query(spark, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return identify(docs, train(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
