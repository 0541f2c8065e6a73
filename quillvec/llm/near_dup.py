"""MinHash near-duplicates with sequential Bayesian verification.

Copies (equal word sequences) collapse first. Their representatives are banded; a bucket's members are compared with
a few centers of it, signature batch by signature batch, and a pair is dropped once the posterior chance of reaching
the threshold falls below MISS. What survives is confirmed on the full shingle sets. Members of a bucket that still
stand in different classes are compared with each other too, as far as they share one of their rarest shingles, which
every pair at the threshold does.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.llm.common import documents, small_batches
from quillvec.llm.components import components
from quillvec.llm.tasks import WordHashes, byte_texts, mixed, odd_numbers
from quillvec.session import settle

SHINGLE = 5
# A link: LINK_OF * intersection >= LINK * union.
LINK, LINK_OF = 75, 100
# A pair at the threshold shares no band with probability (1 - 0.75^4)^40 = 2.4e-7.
BANDS, BAND_ROWS = 40, 4
HASHES = BANDS * BAND_ROWS
# Members of each bucket that all others are compared with.
CENTERS = 2
# Signature batch and the miss probability at which a pair is given up.
BATCH = 32
MISS = 1e-6
# Ids are broadcast to the text scan up to this many (8 MB); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


# --- in the tasks ----------------------------------------------------------------------------------


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle count as one, none as none."""
    w, n = hashes.of(words), len(words)
    factors = odd_numbers(SHINGLE, 11)
    if n < SHINGLE:
        return mixed((w * factors[:n]).sum(keepdims=True) + np.uint64(n)) if n else w
    rows = sum(w[i : n - SHINGLE + 1 + i] * factors[i] for i in range(SHINGLE))
    return np.unique(mixed(rows))


def min_hashes(rows: np.ndarray, factors: np.ndarray) -> np.ndarray:
    lowest = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(rows), 1024):
        lowest = np.minimum(lowest, (factors[:, None] * rows[None, i : i + 1024]).min(axis=1))
    return lowest


SKETCH = "doc_id long, n_shingles long, key binary, signature binary, bands array<long>"


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, factors, mixers = WordHashes(), odd_numbers(HASHES, 23), odd_numbers(BAND_ROWS, 31)
    spread = odd_numbers(BANDS, 37)
    for batch in batches:
        n_shingles, keys, signatures, bands = [], [], [], []
        for text in byte_texts(batch.column("text")):
            words = text.lower().split()
            rows = shingles(words, hashes)
            n_shingles.append(len(rows))
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            if len(rows):
                lowest = min_hashes(rows, factors)
                signatures.append((lowest >> np.uint64(40)).astype("<u2").tobytes())
                banded = mixed((lowest.reshape(BANDS, BAND_ROWS) * mixers).sum(axis=1) ^ spread)
                bands.append(banded.view(np.int64))
            else:
                signatures.append(b"")
                bands.append([])
        yield pa.record_batch(
            [batch.column("doc_id").cast(pa.int64()), pa.array(n_shingles, pa.int64()), pa.array(keys, pa.binary()),
             pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "key", "signature", "bands"],
        )


def shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = [shingles(t.lower().split(), hashes).view(np.int64) for t in byte_texts(batch.column("text"))]
        yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))], names=["node", "rows"])


def least_matches(batch: int = BATCH, hashes: int = HASHES, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches worth going on): below it, the chance of a similarity of the threshold or more,
    under a flat prior, is less than `miss`."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= LINK / LINK_OF
    bounds = []
    for n in range(batch, hashes + 1, batch):
        least = 0
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[high].sum() >= miss * weight.sum():
                least = m
                break
        bounds.append((n, least))
    return bounds


def promising_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that no signature batch rules out; a pair costs no further batch once it is given up."""
    bounds = least_matches()
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig_a", "sig_b")
        )
        alive, seen, matches = np.arange(batch.num_rows), 0, np.zeros(batch.num_rows, dtype=np.int64)
        for n, least in bounds:
            matches[alive] += (left[alive, seen:n] == right[alive, seen:n]).sum(axis=1)
            alive, seen = alive[matches[alive] >= least], n
        yield batch.select(["a", "b"]).take(pa.array(alive))


def confirmed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full shingle sets are similar enough."""
    hashes, last, left = WordHashes(), None, None
    for batch in batches:
        good = []
        a, texts = batch.column("a").to_pylist(), byte_texts(batch.column("text_b"))
        for i, text in enumerate(texts):
            if a[i] != last:
                first = batch.column("text_a").slice(i, 1)
                last, left = a[i], shingles(byte_texts(first)[0].lower().split(), hashes)
            right = shingles(text.lower().split(), hashes)
            shared = len(np.intersect1d(left, right, assume_unique=True))
            if LINK_OF * shared >= LINK * (len(left) + len(right) - shared):
                good.append(i)
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


# --- on Spark --------------------------------------------------------------------------------------


def chosen(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows of the wide `df` with (or, as left_anti, without) an id of the settled `ids`."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near-duplicates: signature batches first, then full sets."""
    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"))
    alive = settle(
        pairs.join(right, "b").join(left, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(promising_batches, "a long, b long"),
        "promising",
    )
    ids = settle(alive.select(F.col("a").alias("doc_id")).union(alive.select("b")).distinct(), "ids")
    wanted = settle(chosen(texts, ids, "doc_id"), "texts")
    # The text of b is shipped with its pair; that of a, which may be in many pairs, is joined where it is used.
    with_b = alive.join(wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return settle(both.select("a", "b", "text_a", "text_b").mapInArrow(confirmed_batches, "a long, b long"), "links")


def shared_bands(banded: DataFrame) -> DataFrame:
    """(band, node, n, center) of all bands with several nodes; `center` marks CENTERS of them.

    Centers are the first nodes by one draw for all bands, so that bands of one group mostly share them.
    """
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    members = settle(banded.join(buckets.select("band"), "band"), "bands")
    draw = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("node"), "node"))
    centers = members.withColumn("place", draw).where(F.col("place") <= CENTERS).select("band", "node", F.lit(True).alias("center"))
    marked = members.join(centers, ["band", "node"], "left").withColumn("center", F.coalesce("center", F.lit(False)))
    return settle(marked, "members")


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs of a center and another member of its band."""
    centers = members.where("center").select("band", F.col("node").alias("c"), F.col("n").alias("n_c"))
    # Sets at the threshold differ in size by the threshold at most.
    alike = (F.col("n") * LINK_OF >= F.col("n_c") * LINK) & (F.col("n_c") * LINK_OF >= F.col("n") * LINK)
    return (
        members.join(centers, "band").where((F.col("node") != F.col("c")) & alike)
        .select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    )


def unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, class so far) of the members of bands of several classes."""
    known = members.select("band", "node").join(labels, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    several = known.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi")
    return settle(known.join(several.select("band"), "band").select("node", "class").distinct(), "unresolved")


def rare_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of (node, class) in different classes that may reach the threshold, none of them missed.

    With all shingles ordered from rare to frequent, two sets at the threshold share one among the first
    n - ceil(n * LINK / LINK_OF) + 1 of each, at places that leave enough behind them (the prefix and positional filters
    of set-similarity joins). A frequent passage stands at the end of that order, so it makes no pairs, and a set with
    many shingles of its own has no partner.
    """
    ids = nodes.select(F.col("node").alias("doc_id")).distinct()
    sets = settle(chosen(texts, settle(ids, "ids"), "doc_id").mapInArrow(shingle_batches, "node long, rows array<long>"), "sets")
    flat = sets.select("node", F.size("rows").alias("n"), F.explode("rows").alias("shingle"))
    shared = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Shingles of one set only come first in the order and meet nothing.
    common = F.count(F.lit(1)).over(Window.partitionBy("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle"))
    ranked = flat.join(shared, "shingle").select("node", "n", "shingle", (F.col("n") - common + rank).alias("place"))
    prefix = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * LINK / LINK_OF) + 1).join(nodes, "node")
    prefix = settle(prefix.select("shingle", "node", "class", "n", "place"), "prefix")
    x, y = (prefix.withColumnsRenamed({c: f"{c}_{side}" for c in ("node", "class", "n", "place")}) for side in "ab")
    # If this shingle is the first that both share, no more than it and what follows in either can be shared.
    most = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    may_link = most * (LINK_OF + LINK) >= (F.col("n_a") + F.col("n_b")) * LINK
    other = (F.col("node_a") < F.col("node_b")) & (F.col("class_a") != F.col("class_b"))
    return x.join(y, "shingle").where(other & may_link).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def joined_classes(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after more links."""
    if found.isEmpty():
        return labels
    known = labels.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return settle(components(known.union(found)), "labels")


def near_duplicates(df: DataFrame) -> DataFrame:
    """Class of every row of `df` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct 5-word shingles of the whole
    text. Texts without words, and null texts, link with nothing. A row without doc_id links with nothing, has a null
    component_id and is kept. Rows of one doc_id are one node, so they share a class. Classes are named by their
    smallest doc_id. An empty table gives no rows. Other columns are ignored.
    """
    with small_batches(df.sparkSession):
        return _classes(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def _classes(texts: DataFrame) -> DataFrame:
    sketch = settle(texts.mapInArrow(sketch_batches, SKETCH), "sketch")
    worded = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = settle(worded.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "copies")
    # Where a doc_id is repeated with its text, one of the rows stands for it.
    nodes = worded.join(first, ["doc_id", "key"], "left_semi")
    banded = nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    members = shared_bands(banded.distinct() if _repeats(sketch) else banded)
    signed = settle(
        worded.select(F.col("doc_id").alias("node"), "key", "signature")
        .join(first.withColumnRenamed("doc_id", "node"), ["node", "key"], "left_semi")
        .join(members.select("node").distinct(), "node", "left_semi").select("node", "signature"),
        "signed",
    )
    labels = settle(components(links(star_pairs(members), signed, texts)), "labels")
    rest = unresolved(members, labels)
    if not rest.isEmpty():
        labels = joined_classes(labels, links(rare_pairs(rest, texts), signed, texts))
    named = first.withColumnRenamed("doc_id", "rep").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("key", F.coalesce("component", "rep").alias("component_id"))
    narrow = sketch.select("doc_id", "n_shingles", "key")
    linked = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return narrow.join(named, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), linked).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _repeats(sketch: DataFrame) -> bool:
    return not sketch.groupBy("doc_id").count().where("count > 1").isEmpty()


def query(spark, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf))


def stage(spark, docs: DataFrame, sf: str) -> DataFrame:
    """Documents without those that are not the smallest of their class; of equal rows one stays."""
    gone = settle(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "gone")
    left = chosen(docs, gone, "doc_id", "left_anti")
    again = settle(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    return chosen(left, again, "doc_id", "left_anti").union(chosen(left, again, "doc_id").dropDuplicates(["doc_id", "text"]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
