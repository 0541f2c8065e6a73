"""Toxicity scores from a factorization machine over hashed terms.

The model adds to the linear weights of the terms a product of factors for every pair of terms, so a pair can count for
more, or less, than its terms do alone. Terms are the distinct words of a text and their first letters (which hold the
stem of an inflected word). Terms that tell the labels apart are chosen by a chi-square test over the training rows;
the machine is fitted on those.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import OWN_KEY, documents, small_batches, with_own_key
from quillvec.llm.near_dup import chosen
from quillvec.llm.tasks import byte_texts
from quillvec.session import settle

# The machine is fitted on at most this many labelled rows, the first in a seeded order.
TRAIN_ROWS = 24_000
TRAIN_PARTS = 12
HASH_BITS = 20
# Letters of a word's beginning that are terms of their own.
STEMS = [4, 5, 6, 8]
# Terms need this chi-square value (chance about one in 600); the strongest are kept.
LEAST_CHI2 = 10.0
TERMS = 2048
FACTORS = 4
STEPS, BATCH, RATE, L2 = 1500, 256, 0.02, 2e-4
THRESHOLD = 0.3
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
VOCABULARY = 200_000


class Machine(NamedTuple):
    """terms: sorted hashes. Scores are the logistic of bias + w.x + sum over pairs of (v_i.v_j) x_i x_j, x 0 or 1."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def word_terms(word: bytes) -> list[int]:
    """Hashed terms of one word: itself and its first letters."""
    mask = (1 << HASH_BITS) - 1
    found = [xxhash.xxh3_64_intdigest(word) & mask]
    letters = word.decode("utf-8", "replace")
    for k in STEMS:
        if len(letters) >= k:
            found.append(xxhash.xxh3_64_intdigest(letters[:k].encode(), seed=k) & mask)
    return found


class Terms(dict):
    """Terms of words seen before; with `wanted`, only places in that sorted list."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.places = None if wanted is None else {int(t): i for i, t in enumerate(wanted)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > VOCABULARY:
            self.clear()
        terms = word_terms(word)
        if self.places is not None:
            terms = [self.places[t] for t in terms if t in self.places]
        value = self[word] = tuple(terms)
        return value

    def of(self, text: bytes) -> list[int]:
        found: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            terms = self[word]
            if terms:
                found.update(terms)
        return sorted(found)


# --- training --------------------------------------------------------------------------------------


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, positive, negative): rows of either label that hold the term, one row per term and task."""
    counts, terms = np.zeros((2, 1 << HASH_BITS), dtype=np.int64), Terms()
    for batch in batches:
        for text, label in zip(byte_texts(batch.column("text")), batch.column("label").to_pylist()):
            counts[label, terms.of(text)] += 1
    held = np.flatnonzero(counts.sum(axis=0))
    yield pa.record_batch(
        [pa.array(held), pa.array(counts[1, held]), pa.array(counts[0, held])], names=["term", "positive", "negative"]
    )


def place_batches(wanted: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(wanted)
        for batch in batches:
            places = [terms.of(t) for t in byte_texts(batch.column("text"))]
            yield pa.record_batch([batch.column("label"), pa.array(places, pa.list_(pa.int32()))], names=["label", "places"])

    return run


def strongest_terms(counts: DataFrame, positive: int, negative: int, terms: int = TERMS) -> np.ndarray:
    """Sorted hashes of the terms whose presence depends most on the label."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n, p, q = float(positive + negative), float(positive), float(negative)
    chi2 = F.lit(n) * F.pow(a * q - b * p, F.lit(2)) / ((a + b) * (F.lit(n) - a - b) * p * q)
    rows = (
        counts.groupBy("term").agg(F.sum("positive").alias("a"), F.sum("negative").alias("b"))
        .where(a + b < n)
        .select("term", chi2.alias("chi2"))
        .where(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "term")
        .limit(terms)
        .collect()
    )
    return np.array(sorted(r["term"] for r in rows), dtype=np.int64)


def fit(terms: np.ndarray, places: list[list[int]], labels: np.ndarray) -> Machine:
    """Minimise log loss by Adam over seeded batches."""
    rows, size = len(places), max(len(terms), 1)
    held = np.zeros((rows, size), dtype=np.uint8)
    for i, p in enumerate(places):
        held[i, p] = 1
    draw = np.random.default_rng(7)
    prior = min(max(labels.mean() if rows else 0.0, 1e-3), 1 - 1e-3)
    parts = [np.array([np.log(prior / (1 - prior))]), np.zeros(size), draw.normal(0, 0.05, (size, FACTORS))]
    first, second = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    order = draw.permutation(rows)
    for step in range(1, STEPS + 1 if rows and len(terms) else 1):
        at = (np.arange(BATCH) + step * BATCH) % rows
        x, y = held[order[at]].astype(np.float64), labels[order[at]]
        bias, weights, factors = parts
        crossed = x @ factors
        raw = bias + x @ weights + 0.5 * ((crossed**2).sum(axis=1) - x @ (factors**2).sum(axis=1))
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(y)
        slopes = [
            np.array([error.sum()]),
            x.T @ error + L2 * weights,
            x.T @ (error[:, None] * crossed) - (x.T @ error)[:, None] * factors + L2 * factors,
        ]
        rate = RATE * (1 - 0.9 * step / STEPS)
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            parts[k] = parts[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(parts[0][0]), parts[1], parts[2])


def train(docs: DataFrame, labels: DataFrame, keep: Column) -> Machine:
    """Fit on the labelled rows for which `keep`, a condition on doc_id, holds; of a doc_id's labels the largest counts.

    At most TRAIN_ROWS rows, the first by a hash of doc_id, are read; the driver gets places of TERMS terms for them.
    Without rows of both labels the score is the share of toxic rows among them, 0.1 % at least and 99.9 % at most.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & keep).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("label")
    )
    sample = settle(known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(TRAIN_ROWS), "labelled")
    texts = chosen(docs.select("doc_id", "text"), sample.select("doc_id"), "doc_id")
    rows = settle(
        texts.join(F.broadcast(sample), "doc_id").select("label", "text").repartition(TRAIN_PARTS, F.xxhash64("text")), "training"
    )
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    positive, negative = seen.get(1, 0), seen.get(0, 0)
    if not positive or not negative:
        share = min(max(positive / max(positive + negative, 1), 1e-3), 1 - 1e-3)
        return Machine(np.zeros(0, dtype=np.int64), float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, FACTORS)))
    with small_batches(docs.sparkSession):
        counts = rows.mapInArrow(count_batches, "term long, positive long, negative long")
        terms = strongest_terms(counts, positive, negative)
        places = settle(rows.mapInArrow(place_batches(terms), "label int, places array<int>"), "places")
    placed = places.orderBy(F.xxhash64("places", "label")).collect()
    return fit(terms, [r["places"] for r in placed], np.array([r["label"] for r in placed], dtype=np.float64))


# --- scoring ---------------------------------------------------------------------------------------


def score_batches(machine: Machine) -> Callable:
    squares = (machine.factors**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.terms)
        for batch in batches:
            scores = []
            for text in byte_texts(batch.column("text")):
                at = terms.of(text)
                crossed = machine.factors[at].sum(axis=0)
                raw = machine.bias + machine.weights[at].sum() + 0.5 * ((crossed**2).sum() - squares[at].sum())
                scores.append(1 / (1 + np.exp(-min(max(raw, -30.0), 30.0))))
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of every row of `docs`; a null or empty text gets the score of no terms."""
    return scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), machine)


def scores(rows: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, of any type, and score of `rows` (doc_id, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    with small_batches(rows.sparkSession):
        return settle(rows.mapInArrow(score_batches(machine), f"doc_id {kind}, score double"), "scores")


def held_out() -> Column:
    """The rows whose labels are not learnt."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(spark, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    machine = train(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~held_out())
    return toxicity(docs, machine).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def stage(spark, docs: DataFrame, sf: str) -> DataFrame:
    """Documents that are not scored as toxic.

    Rows that share a doc_id with a toxic one go too; a row without doc_id is judged by its own text, as are its copies
    without doc_id. Repeated rows are kept or dropped together, an empty table stays empty, and other columns, whatever
    their names, come back as they are.
    """
    machine = train(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~held_out())
    keyed = with_own_key(docs)
    scored = scores(keyed.select(F.col(OWN_KEY).alias("doc_id"), "text"), machine)
    toxic = settle(scored.where(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias(OWN_KEY)).distinct(), "toxic")
    return chosen(keyed, toxic, OWN_KEY, "left_anti").select(*docs.columns)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
