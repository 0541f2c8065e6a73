"""Top-k similarity search over a corpus.

corpus:   id long, embedding array<float>, [part int], [any payload columns]
requests: query_id long, query_vec array<float>, top_k int, threshold double, [parameter columns]
ranked:   query_id, id, rank, similarity, [payload columns]

Ids are unique per corpus and query ids per request table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec import constants as const
from quillvec.functions.vector import cosine_similarity, has_embedding
from quillvec.operators.scoring import PARTIAL_SCHEMA, PairRule, RequestSet, Scorer, pack_requests
from quillvec.session import settle

# Requests travel to every task only below this many floats (64 MB) and rows.
BROADCAST_FLOATS = 16_000_000
BROADCAST_REQUESTS = 200_000
# ... whose parameters are below this many bytes, and that keep no more rows than this per task.
BROADCAST_PARAM_BYTES = 64_000_000
HELD_ROWS = 2_000_000
# Partial results of a request are cut to its best in this many parts first, then as a whole.
MERGE_PARTS = 16
# Ranked rows are broadcast to fetch their payload only below this many rows.
BROADCAST_ROWS = 500_000
# A scan's tasks are as many as its files' splits, and each scores all requests: with more requests than these and more
# pairs in all than these, blocks of both sides share the work.
SCAN_REQUESTS = 1000
SCAN_PAIRS = 500_000_000
# Block sizes of the cogroup path, in floats: 16 MB of corpus meets 4 MB of requests, and no more rows than these
# whatever their size, so the pairs that one task scores don't grow with the tables. The corpus is shuffled once per
# request block and the requests once per corpus block.
BLOCK_FLOATS = 4_000_000
REQUEST_BLOCK_FLOATS = 1_000_000
BLOCK_ROWS = 65_536
REQUEST_BLOCK_ROWS = 16_384
# Rows of a block that are scored at a time.
SCORED_ROWS = 4096
# Tasks of the cogroup path are as many as its pairs of blocks, up to this number.
BLOCK_TASKS = 20_000


def default_requests(requests: DataFrame, top_k: int, threshold: float) -> DataFrame:
    """Fill missing or null top_k and threshold; an explicit 0.0 stays."""
    have = requests.columns
    k = F.coalesce(F.col("top_k"), F.lit(top_k)) if "top_k" in have else F.lit(top_k)
    t = F.coalesce(F.col("threshold"), F.lit(threshold)) if "threshold" in have else F.lit(threshold)
    return requests.withColumns({"top_k": k.cast("int"), "threshold": t.cast("double")})


def _request_size(requests: DataFrame, params: Sequence[str]) -> tuple[int, int, int, int, int]:
    """(requests, floats, widest top_k, sum of top_k, bytes of the parameters)."""
    written = F.octet_length(F.to_json(F.struct(*params))) if params else F.lit(0)
    row = requests.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.size("query_vec")), F.lit(0)).alias("floats"),
        F.coalesce(F.max("top_k"), F.lit(0)).alias("widest"),
        F.coalesce(F.sum(F.col("top_k").cast("long")), F.lit(0)).alias("wanted"),
        F.coalesce(F.sum(written), F.lit(0)).alias("bytes"),
    ).first()
    return row["n"], row["floats"], row["widest"], row["wanted"], row["bytes"]


def _scan_side(corpus: DataFrame, extra: Sequence[str]) -> DataFrame:
    part = F.col("part").cast("int") if "part" in corpus.columns else F.lit(0)
    names = [name for name in dict.fromkeys(extra) if name != "part"]
    return corpus.filter(has_embedding(F.col("embedding"))).select(
        F.col("id").cast("long").alias("id"), part.alias("part"), F.col("embedding").cast("array<float>"), *names
    )


def _scan(corpus: DataFrame, packed: dict, metric: str, totals: bool, rules: Sequence[PairRule], cell_col=None) -> DataFrame:
    """Partial results with the requests carried to the corpus: no corpus shuffle."""
    # Plain arrays travel, not objects: broadcast values are unpickled where this package is not installed.
    carried = corpus.sparkSession.sparkContext.broadcast({dim: dict(vars(some)) for dim, some in packed.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {dim: RequestSet(**fields) for dim, fields in carried.value.items()}
        scorer = Scorer(asked, metric, totals, rules, cell_col)
        for batch in batches:
            scorer.add(batch)
        yield from scorer.results()

    extra = [rule.corpus_col for rule in rules] + ([cell_col] if cell_col else [])
    return _scan_side(corpus, extra).mapInArrow(score, PARTIAL_SCHEMA)


def block_rows(dim: int, floats: int, rows: int) -> int:
    """Rows of a block of vectors."""
    return max(1, min(rows, floats // max(1, dim)))


def meet_in_blocks(
    corpus: DataFrame, requests: DataFrame, keys: Sequence[str], pairs: int, metric: str, totals: bool, rules: Sequence[PairRule]
) -> DataFrame:
    """Partial results of corpus blocks and request blocks that share a key; both blocks, and their pairs in a task, are bounded."""
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, min(BLOCK_TASKS, pairs))
    corpus, requests = corpus.repartition(tasks, *keys), requests.repartition(tasks, *keys)
    params = list(dict.fromkeys(rule.request_col for rule in rules))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        scorer = Scorer(pack_requests(right, params), metric, totals, rules)
        for batch in left.to_batches(max_chunksize=SCORED_ROWS):
            scorer.add(batch)
        batches = list(scorer.results())
        return pa.Table.from_batches(batches) if batches else _empty_partials()

    return (
        corpus.groupBy(*keys).cogroup(requests.groupBy(*keys)).applyInArrow(score, PARTIAL_SCHEMA)
    )


def _empty_partials() -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int32()]
    names = ["query_id", "part", "id", "score", "matched", "top_k"]
    return pa.table({name: pa.array([], type=kind) for name, kind in zip(names, kinds)})


def _blocks(
    corpus: DataFrame, requests: DataFrame, floats: int, count: int, metric: str, totals: bool, rules: Sequence[PairRule]
) -> DataFrame:
    """Partial results with both sides cut into blocks by id hash; every pair of blocks meets once."""
    side = _scan_side(corpus, [rule.corpus_col for rule in rules])
    dim = max(1, floats // max(1, count))
    corpus_blocks = max(1, -(-side.count() // block_rows(dim, BLOCK_FLOATS, BLOCK_ROWS)))
    request_blocks = max(1, -(-count // block_rows(dim, REQUEST_BLOCK_FLOATS, REQUEST_BLOCK_ROWS)))
    cut = side.withColumn("_cb", F.pmod(F.xxhash64("id", "part"), F.lit(corpus_blocks)).cast("int")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(request_blocks - 1)))
    )
    params = list(dict.fromkeys(rule.request_col for rule in rules))
    asked = (
        requests.select("query_id", "query_vec", "top_k", "threshold", *params)
        .withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(request_blocks)).cast("int"))
        .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1))))
    )
    return meet_in_blocks(cut, asked, ["_qb", "_cb"], corpus_blocks * request_blocks, metric, totals, rules)


def _rank(partials: DataFrame, widest: int, totals: bool) -> DataFrame:
    """The best of each request, in two cuts, so that no group holds what all tasks found for a request.

    Totals are a sum of their own: a sum window would keep the ranking from being cut before the shuffle.
    """
    if totals:
        # Ranking and counting both read what the tasks found; score once.
        partials = settle(partials, "partials")
    best_first = [F.desc_nulls_last("score"), "part", "id"]
    found = partials.filter(F.col("id").isNotNull()).withColumn("_cut", F.pmod(F.xxhash64("id"), F.lit(MERGE_PARTS)))
    first = F.row_number().over(Window.partitionBy("query_id", "_cut").orderBy(*best_first))
    cut = found.withColumn("rank", first).filter(F.col("rank") <= widest).drop("rank", "_cut")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first))
    ranked = cut.withColumn("rank", place).filter(F.col("rank") <= widest)
    ranked = ranked.filter(F.col("rank") <= F.col("top_k")).drop("matched", "top_k")
    if not totals:
        return ranked
    counts = partials.groupBy("query_id").agg(F.sum("matched").alias("total"))
    return ranked.join(counts, "query_id")


def _partials(
    corpus: DataFrame, requests: DataFrame, metric: str, totals: bool, rules: Sequence[PairRule], broadcast_floats: int
) -> tuple[DataFrame, int, int]:
    """(partial results, widest top_k, sum of top_k)."""
    params = list(dict.fromkeys(rule.request_col for rule in rules))
    count, floats, widest, wanted, written = _request_size(requests, params)
    few = floats <= broadcast_floats and count <= BROADCAST_REQUESTS
    if few and wanted <= HELD_ROWS and written <= BROADCAST_PARAM_BYTES and scannable(corpus, count):
        asked = requests.select("query_id", "query_vec", "top_k", "threshold", *params).toArrow()
        return _scan(corpus, pack_requests(asked, params), metric, totals, rules), widest, wanted
    return _blocks(corpus, requests, floats, count, metric, totals, rules), widest, wanted


def scannable(corpus: DataFrame, count: int) -> bool:
    """Whether a scan's tasks score few enough pairs with so many requests."""
    return count <= SCAN_REQUESTS or corpus.count() * count <= SCAN_PAIRS


# Ids of one folder of a corpus that is written by id.
BUCKET_IDS = 1_000_000


def id_bucket(ids: Column) -> Column:
    return F.floor(ids / BUCKET_IDS).cast("long")


def with_id_bucket(corpus: DataFrame) -> DataFrame:
    """The corpus with `id_bucket`, to be written by (partition_by): payloads are then read from the winners' folders."""
    return corpus.withColumn("id_bucket", id_bucket(F.col("id")))


def attach(ranked: DataFrame, corpus: DataFrame, payload: Sequence[str], wanted: int) -> DataFrame:
    """Fetch payload columns for ranked rows only; the ranked side is broadcast while it is known to be small.

    If the corpus is stored by `id_bucket`, only the folders that hold winners are read.
    """
    if not payload:
        return ranked
    keys = ["part", "id"] if "part" in corpus.columns else ["id"]
    if "id_bucket" in corpus.columns:
        ranked, keys = with_id_bucket(ranked), [*keys, "id_bucket"]
    small = F.broadcast(ranked) if wanted <= BROADCAST_ROWS else ranked
    return corpus.select(*keys, *payload).join(small, keys, "inner")


def search_batch(
    corpus: DataFrame,
    requests: DataFrame,
    payload: Sequence[str] = (),
    *,
    metric: str = "cosine",
    totals: bool = False,
    rules: Sequence[PairRule] = (),
    broadcast_floats: int = BROADCAST_FLOATS,
) -> DataFrame:
    """Per request: the `top_k` best rows with similarity >= threshold, ties by id.

    `totals` adds `total`, the number of all rows at or above the threshold. With metric `l2` the score is
    the negated squared distance.
    """
    requests = default_requests(requests, const.SEARCH_TOP_N, const.SEARCH_THRESHOLD)
    partials, widest, wanted = _partials(corpus, requests, metric, totals, rules, broadcast_floats)
    ranked = _rank(partials, widest, totals)
    ranked = ranked.withColumnRenamed("score", "similarity")
    return _ordered(attach(ranked, corpus, payload, wanted), payload, totals, "part" in corpus.columns)


def _ordered(ranked: DataFrame, payload: Sequence[str], totals: bool, parts: bool) -> DataFrame:
    lead = ["query_id", "id", "rank", "similarity"] + (["total"] if totals else []) + (["part"] if parts else [])
    return ranked.select(*lead, *payload)


def search_block(corpus: DataFrame, requests: DataFrame, payload: Sequence[str] = (), **options) -> DataFrame:
    """`search_batch` forced onto the path for many requests: block meets block, nothing is carried around."""
    return search_batch(corpus, requests, payload, broadcast_floats=-1, **options)


def search_topk(
    corpus: DataFrame,
    query_vec: Sequence[float],
    top_n: int = const.SEARCH_TOP_N,
    threshold: float = const.SEARCH_THRESHOLD,
    payload: Sequence[str] = (),
) -> DataFrame:
    """One query: id, similarity and payload of the best `top_n` rows at or above the threshold, best first."""
    asked = pa.table(
        {
            "query_id": pa.array([0], pa.int64()),
            "query_vec": pa.array([list(query_vec)], pa.list_(pa.float32())),
            "top_k": pa.array([top_n], pa.int32()),
            "threshold": pa.array([threshold], pa.float64()),
        }
    )
    partials = _scan(corpus, pack_requests(asked), "cosine", False, ())
    best = partials.orderBy(F.desc("score"), "id").limit(top_n).select("part", "id", F.col("score").alias("similarity"))
    found = attach(best, corpus, payload, top_n).select("id", "similarity", *payload)
    return found.orderBy(F.desc("similarity"), "id")


def search_l2(corpus: DataFrame, requests: DataFrame, top_k: int = const.STORE_TOP_K) -> DataFrame:
    """The `top_k` nearest rows by squared Euclidean distance, without a threshold."""
    asked = requests.select("query_id", "query_vec").withColumns(
        {"top_k": F.lit(top_k), "threshold": F.lit(float("-inf"))}
    )
    found = search_batch(corpus, asked, metric="l2")
    return found.select("query_id", "id", "rank", (-F.col("similarity")).alias("distance_sq"))


HYBRID_COLUMNS = [
    "product_id", "product_name", "category", "description", "price",
    "stock_quantity", "last_updated", "full_text_context",
]
HYBRID_RULES = [
    PairRule("eq", "category", "category"),
    PairRule("ge", "_cents", "_min_cents"),
    PairRule("le", "_cents", "_max_cents"),
]


def _cents(price: Column) -> Column:
    return (price.cast("decimal(18,2)") * 100).cast("long")


def optional_filters(
    products: DataFrame, category: str | None = None, min_price: float | None = None, max_price: float | None = None
) -> DataFrame:
    """Category equality and inclusive price bounds; None leaves its predicate out, so the rest is pushed down."""
    if category is not None:
        products = products.filter(F.col("category") == category)
    if min_price is not None:
        products = products.filter(F.col("price") >= F.lit(min_price))
    if max_price is not None:
        products = products.filter(F.col("price") <= F.lit(max_price))
    return products


def search_hybrid(
    products: DataFrame,
    query_vec: Sequence[float],
    threshold: float = const.HYBRID_THRESHOLD,
    top_n: int = const.HYBRID_TOP_N,
    category: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    payload: Sequence[str] = HYBRID_COLUMNS,
) -> DataFrame:
    """Filters and threshold before the top N; similarity_score and distance with the product columns."""
    kept = optional_filters(products, category, min_price, max_price)
    found = search_topk(kept, query_vec, top_n, threshold, payload)
    return found.select(
        "id", *payload, F.col("similarity").alias("similarity_score"), (1.0 - F.col("similarity")).alias("distance")
    )


def search_hybrid_batch(products: DataFrame, requests: DataFrame, payload: Sequence[str] = HYBRID_COLUMNS, **options) -> DataFrame:
    """Hybrid search for a request table with nullable category, min_price and max_price per request."""
    asked = default_requests(requests, const.HYBRID_TOP_N, const.HYBRID_THRESHOLD).select(
        "query_id", "query_vec", "top_k", "threshold", "category",
        F.ceil(F.col("min_price").cast("decimal(20,4)") * 100).cast("long").alias("_min_cents"),
        F.floor(F.col("max_price").cast("decimal(20,4)") * 100).cast("long").alias("_max_cents"),
    )
    shelf = products.withColumn("_cents", _cents(F.col("price")))
    found = search_batch(shelf, asked, payload, rules=HYBRID_RULES, **options)
    return found.select(
        "query_id", "id", "rank", *payload,
        F.col("similarity").alias("similarity_score"), (1.0 - F.col("similarity")).alias("distance"),
    )


def cross_requests(corpus: DataFrame, requests: DataFrame, **options) -> DataFrame:
    """Every request against every corpus row: rows at or above its threshold and the best similarity.

    Matches are counted inside the tasks; pairs are never emitted.
    """
    asked = requests.withColumn("top_k", F.lit(1))
    found = search_batch(corpus, asked, totals=True, **options)
    best = found.select("query_id", F.col("total").alias("matched"), F.col("similarity").alias("best_similarity"))
    return requests.select("query_id", "threshold").join(best, "query_id", "left").select(
        "query_id", "threshold", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), "best_similarity"
    )


def match_counts(
    corpus: DataFrame,
    requests: DataFrame,
    min_suggestions: int = const.MIN_SUGGESTIONS,
    threshold: float = const.CHAT_THRESHOLD,
) -> DataFrame:
    """Rows at or above the threshold per request, zero included, with the two flags built on that count."""
    counted = cross_requests(corpus, default_requests(requests, 1, threshold))
    return counted.select(
        "query_id",
        "matched",
        (F.col("matched") >= min_suggestions).alias("has_multiple"),
        (F.col("matched") >= const.CHAT_SUGGESTION_MIN_MATCHES).alias("show_suggestions"),
    )


def filter_selected_ids(rows: DataFrame, selected: Sequence[int] | DataFrame | None, column: str = "id") -> DataFrame:
    """Keep the chosen ids; an empty or missing list keeps everything.

    A list becomes a pushed-down IN predicate, a DataFrame of ids (one column) a semi join.
    """
    if selected is None:
        return rows
    if isinstance(selected, DataFrame):
        chosen = selected.toDF(column)
        return rows.join(chosen, column, "left_semi")
    return rows.filter(F.col(column).isin(list(selected))) if len(selected) else rows


def filter_files(rows: DataFrame, files: Sequence[str] | DataFrame | None, column: str = "file_name") -> DataFrame:
    """Keep rows of the listed files; an empty or missing list keeps everything."""
    return filter_selected_ids(rows, files, column)


def restrict_to_selection(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Candidate rows (query_id, id) within their request's chosen ids; requests without a choice keep all."""
    free = requests.filter(F.coalesce(F.size("selected_ids"), F.lit(0)) <= 0).select("query_id")
    chosen = _selection(requests).select("query_id", "id")
    unrestricted = candidates.join(free, "query_id", "left_semi")
    return unrestricted.unionByName(candidates.join(chosen, ["query_id", "id"], "left_semi"))


def _selection(requests: DataFrame) -> DataFrame:
    return requests.withColumn("id", F.explode(F.array_distinct("selected_ids")))


def retrieve_selected(
    corpus: DataFrame, requests: DataFrame, payload: Sequence[str] = (), threshold: float = const.CHAT_THRESHOLD
) -> DataFrame:
    """Rank only the rows a request chose: an equi join on id, the threshold, no truncation."""
    asked = _selection(default_requests(requests, const.CHAT_TOP_K, threshold))
    similarity = cosine_similarity(F.col("query_vec"), F.col("embedding"))
    pairs = (
        corpus.filter(has_embedding(F.col("embedding")))
        .join(asked.select("query_id", "query_vec", "threshold", "id"), "id")
        .filter(F.size("query_vec") == F.size("embedding"))
        .withColumn("similarity", similarity)
    )
    pairs = pairs.filter(F.col("similarity") >= F.col("threshold"))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rank", F.row_number().over(best_first)).select(
        "query_id", "id", "rank", "similarity", *payload
    )


def retrieve_multi_table(
    tables: dict[str, DataFrame], requests: DataFrame, payload: Sequence[str] = (), table_name: str | None = None, **options
) -> DataFrame:
    """Search several corpora as one and tag each row with its table; ties by table name, then id.

    An explicit `table_name` wins over the list. A `table_names` array in the requests narrows the list per
    request; null or empty means every table.
    """
    names = [table_name] if table_name else sorted(tables)
    merged: DataFrame | None = None
    for number, name in enumerate(names):
        tagged = tables[name].select("id", "embedding", *payload).withColumn("part", F.lit(number))
        merged = tagged if merged is None else merged.unionByName(tagged)
    rules: list[PairRule] = []
    if "table_names" in requests.columns and not table_name:
        numbers = F.create_map(*[F.lit(x) for pair in zip(names, range(len(names))) for x in pair])
        # A name outside the list stays as -1, so a request for unknown tables only finds nothing.
        wanted = F.transform("table_names", lambda name: F.coalesce(F.try_element_at(numbers, name), F.lit(-1)))
        requests = requests.withColumn("_parts", wanted)
        rules = [PairRule("among", "part", "_parts")]
    found = search_batch(merged, requests, payload, rules=rules, **options)
    labels = F.array(*[F.lit(name) for name in names])
    return found.withColumn("table_name", F.get(labels, F.col("part"))).drop("part")
