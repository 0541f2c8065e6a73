import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillvec.operators import ann, search
from quillvec.session import settle

CORPUS = "id long, embedding array<float>"
REQUESTS = "query_id long, query_vec array<float>, top_k int, threshold double"


def cosine(a, b):
    a, b = np.asarray(a, np.float32).astype(float), np.asarray(b, np.float32).astype(float)
    if len(a) != len(b):
        return None
    scale = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return 0.0 if scale == 0 else float((a * b).sum() / scale)


def brute(corpus, requests, keep=lambda q, c: True):
    out, totals = [], {}
    for q in requests:
        scored = []
        for c in corpus:
            if c[1] is None or not len(c[1]) or not keep(q, c):
                continue
            s = cosine(q[1], c[1])
            if s is not None and s >= q[3]:
                scored.append((-round(s, 12), c[0]))
        totals[q[0]] = len(scored)
        out += [(q[0], i, n + 1, round(-s, 6)) for n, (s, i) in enumerate(sorted(scored)[: q[2]])]
    return sorted(out), totals


def collected(found):
    return sorted((r.query_id, r.id, r["rank"], round(r.similarity, 6)) for r in found.collect())


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows are copies of one vector; some are null, empty, zero or of another size."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).round(3).tolist()) for i in range(1200)]
    hot = rng.normal(size=24).round(3).tolist()
    rows += [(i, hot) for i in range(1200, 1800)]
    rows += [(1800, None), (1801, []), (1802, [0.0] * 24), (1803, [1.0] * 7), (1804, [float("nan")] * 24)]
    asks = [(i, rng.normal(size=24).round(3).tolist(), int(1 + i % 9), float(-0.2 + 0.1 * (i % 5))) for i in range(40)]
    asks += [(100, hot, 5, 0.9), (101, hot, 700, 0.5), (102, [0.0] * 24, 3, 0.0), (103, [1.0] * 7, 3, 0.5),
             (104, hot, 4, 2.0)]
    return rows, asks


def frames(spark, rows, asks):
    return spark.createDataFrame(rows, CORPUS).repartition(6), spark.createDataFrame(asks, REQUESTS)


def drop_nan(rows):
    return [r for r in rows if r[1] is None or not np.isnan(r[1]).any()]


@pytest.mark.parametrize("floats", [search.BROADCAST_FLOATS, -1])
def test_equals_brute_force_with_copies(spark, skewed, monkeypatch, floats):
    monkeypatch.setattr(search, "BLOCK_FLOATS", 600)
    monkeypatch.setattr(search, "REQUEST_BLOCK_FLOATS", 300)
    rows, asks = skewed
    corpus, requests = frames(spark, rows, asks)
    found = search.search_batch(corpus, requests, totals=True, broadcast_floats=floats)
    expected, totals = brute(drop_nan(rows), asks)
    assert collected(found) == expected
    assert {r.query_id: r.total for r in found.select("query_id", "total").distinct().collect()} == {
        q: n for q, n in totals.items() if n
    }
    plain = search.search_batch(corpus, requests, broadcast_floats=floats)
    assert collected(plain) == expected


def test_small_rescore_budget(spark, skewed, monkeypatch):
    from quillvec.operators import scoring

    rows, asks = skewed
    packed_rows = pd.DataFrame(drop_nan(rows), columns=["id", "embedding"])
    monkeypatch.setattr(scoring, "RESCORE_FLOATS", 240)
    monkeypatch.setattr(scoring, "REQUEST_BLOCK", 7)
    import pyarrow as pa

    batch = pa.table({"id": pa.array(packed_rows["id"], pa.int64()), "part": pa.array([0] * len(packed_rows), pa.int32()),
                      "embedding": pa.array(packed_rows["embedding"].tolist(), pa.list_(pa.float32()))})
    table = pa.table({"query_id": pa.array([a[0] for a in asks], pa.int64()),
                      "query_vec": pa.array([a[1] for a in asks], pa.list_(pa.float32())),
                      "top_k": pa.array([a[2] for a in asks], pa.int32()),
                      "threshold": pa.array([a[3] for a in asks], pa.float64())})
    scorer = scoring.Scorer(scoring.pack_requests(table), "cosine", True, ())
    for piece in batch.to_batches(max_chunksize=500):
        scorer.add(piece)
    got = pa.Table.from_batches(list(scorer.results())).to_pandas()
    expected, totals = brute(drop_nan(rows), asks)
    best = got[got["id"].notna()]
    assert sorted(zip(best.query_id, best.id.astype(int), best.score.round(6))) == sorted(
        (q, i, s) for q, i, _, s in expected
    )
    counted = got[got["matched"].notna()]
    assert dict(zip(counted.query_id, counted.matched.astype(int))) == {q: n for q, n in totals.items() if n}


def test_threshold_is_inclusive_and_zero_is_kept(spark):
    corpus, requests = frames(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], [(1, [1.0, 0.0], 5, 0.0)])
    assert [(r.id, r.similarity) for r in search.search_batch(corpus, requests).orderBy("rank").collect()] == [
        (1, 1.0), (2, 0.0),
    ]
    exact = [(2, [1.0, 0.0], 5, 1.0)]
    assert search.search_batch(corpus, spark.createDataFrame(exact, REQUESTS)).count() == 1


def test_empty_sides(spark):
    corpus, requests = frames(spark, [(1, [1.0, 0.0])], [(1, [1.0, 0.0], 5, 0.0)])
    assert search.search_batch(corpus.limit(0), requests).count() == 0
    assert search.search_batch(corpus, requests.limit(0)).count() == 0
    assert search.search_block(corpus, requests.limit(0)).count() == 0


def test_top_k_larger_than_corpus_and_payload(spark):
    corpus, requests = frames(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.1])], [(1, [1.0, 0.0], 20, 0.0)])
    found = search.search_batch(corpus.withColumn("note", F.lit("n")), requests, ["note"])
    assert sorted((r.id, r.note) for r in found.collect()) == [(1, "n"), (2, "n")]


def test_defaults(spark):
    corpus = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(30)], CORPUS)
    asked = spark.createDataFrame([(1, [1.0, 0.0], None, None), (2, [-1.0, 0.0], 5, 0.0)], REQUESTS)
    found = search.search_batch(corpus, asked)
    assert found.filter("query_id = 1").count() == 10
    assert found.filter("query_id = 2").count() == 0


def test_search_topk_order(spark):
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.9, 0.1]), (9, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, CORPUS)
    assert [r.id for r in search.search_topk(corpus, [1.0, 0.0], 3, 0.1).collect()] == [3, 5, 4]
    noted = corpus.withColumn("note", F.concat(F.lit("n"), F.col("id")))
    for limit in (3, 2000):
        found = search.search_topk(noted, [1.0, 0.0], limit, 0.1, ["note"]).collect()
        assert [(r.id, r.note) for r in found] == [(3, "n3"), (5, "n5"), (4, "n4")]
    assert search.search_topk(noted, [1.0, 0.0], 3, 2.0, ["note"]).count() == 0


def test_l2_matches_brute_force(spark, skewed):
    rows, asks = skewed
    corpus, requests = frames(spark, rows, asks)
    got = sorted((r.query_id, r.id, r["rank"]) for r in search.search_l2(corpus, requests, 6).collect())
    expected = []
    for q in asks:
        scored = []
        for c in drop_nan(rows):
            if c[1] and len(c[1]) == len(q[1]):
                gap = np.asarray(q[1], np.float32).astype(float) - np.asarray(c[1], np.float32).astype(float)
                scored.append((round(float((gap * gap).sum()), 9), c[0]))
        expected += [(q[0], i, n + 1) for n, (_, i) in enumerate(sorted(scored)[:6])]
    assert got == sorted(expected)


@pytest.mark.parametrize("floats", [search.BROADCAST_FLOATS, -1])
def test_pair_rules(spark, skewed, monkeypatch, floats):
    monkeypatch.setattr(search, "BLOCK_FLOATS", 2000)
    rows, asks = skewed
    corpus, requests = frames(spark, rows, asks)
    shelf = corpus.withColumn("category", F.when(F.col("id") % 4 != 3, F.concat(F.lit("c"), F.col("id") % 4))).withColumn(
        "price", F.when(F.col("id") % 5 != 0, F.col("id") / 10).cast("decimal(18,2)")
    )
    asked = requests.withColumn("category", F.when(F.col("query_id") % 2 == 0, F.lit("c1"))).withColumn(
        "min_price", F.when(F.col("query_id") % 3 == 0, F.lit(40.05))
    ).withColumn("max_price", F.when(F.col("query_id") % 3 == 1, F.lit(90.0)))

    def keep(q, c):
        if q[0] % 2 == 0 and c[0] % 4 != 1:
            return False
        if q[0] % 3 == 0 and (c[0] % 5 == 0 or c[0] / 10 < 40.05):
            return False
        return not (q[0] % 3 == 1 and (c[0] % 5 == 0 or c[0] / 10 > 90))

    found = search.search_hybrid_batch(shelf, asked, ["category"], broadcast_floats=floats)
    got = sorted((r.query_id, r.id, r["rank"], round(r.similarity_score, 6)) for r in found.collect())
    assert got == brute(drop_nan(rows), asks, keep)[0]


def test_match_counts_keep_zero(spark, skewed):
    rows, asks = skewed
    corpus, requests = frames(spark, rows, asks)
    got = {r.query_id: (r.matched, r.has_multiple, r.show_suggestions) for r in search.match_counts(corpus, requests).collect()}
    _, totals = brute(drop_nan(rows), asks)
    assert got == {q: (n, n >= 2, n >= 3) for q, n in totals.items()}
    assert got[104] == (0, False, False)


def test_selected_ids(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], CORPUS)
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0], 1, 0.5, [2, 1, 3, 99, 1]), (2, [1.0, 0.0], 1, 0.5, []), (3, [1.0, 0.0], 1, 0.5, None)],
        REQUESTS + ", selected_ids array<long>",
    )
    found = search.retrieve_selected(corpus, asked)
    assert sorted((r.query_id, r.id, r["rank"]) for r in found.collect()) == [(1, 1, 1), (1, 2, 2)]
    candidates = spark.createDataFrame([(1, 1), (1, 4), (2, 4), (3, 9)], "query_id long, id long")
    kept = search.restrict_to_selection(candidates, asked)
    assert sorted((r.query_id, r.id) for r in kept.collect()) == [(1, 1), (2, 4), (3, 9)]
    assert search.filter_selected_ids(corpus, []).count() == 4
    assert search.filter_selected_ids(corpus, None).count() == 4
    assert search.filter_selected_ids(corpus, [3, 77]).count() == 1
    assert search.filter_selected_ids(corpus, spark.createDataFrame([(3,), (4,)], "x long")).count() == 2


def test_multi_table(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], CORPUS)
    b = spark.createDataFrame([(1, [1.0, 0.0]), (7, [0.9, 0.1])], CORPUS)
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0], 3, 0.5, None), (2, [1.0, 0.0], 3, 0.5, ["b"]), (3, [1.0, 0.0], 3, 0.5, ["nowhere"])],
        REQUESTS + ", table_names array<string>",
    )
    found = search.retrieve_multi_table({"b": b, "a": a}, asked)
    assert sorted((r.query_id, r["rank"], r.table_name, r.id) for r in found.collect()) == [
        (1, 1, "a", 1), (1, 2, "b", 1), (1, 3, "b", 7), (2, 1, "b", 1), (2, 2, "b", 7),
    ]
    only = search.retrieve_multi_table({"b": b, "a": a}, asked, table_name="a")
    assert {r.table_name for r in only.collect()} == {"a"}


@pytest.mark.parametrize("floats", [search.BROADCAST_FLOATS, -1])
def test_ann(spark, skewed, monkeypatch, floats):
    monkeypatch.setattr(ann, "BLOCK_FLOATS", 1200)
    rows, asks = skewed
    corpus, requests = frames(spark, drop_nan(rows), asks)
    centroids = ann.train_cells(corpus.filter(F.size("embedding") == 24), 8)
    indexed = settle(ann.cluster_by_cell(ann.assign_cells(corpus, centroids), 5), "cells")
    asked = requests.filter(F.size("query_vec") == 24)
    every = ann.search_ann(indexed, asked, centroids, probes=8, broadcast_floats=floats)
    exact = search.search_batch(corpus, asked)
    assert collected(every) == collected(exact)
    some = ann.search_ann(indexed, asked, centroids, probes=4, broadcast_floats=floats)
    assert {(q, i) for q, i, _, _ in collected(some)} <= {
        (r.query_id, r.id) for r in search.search_batch(corpus, asked.withColumn("top_k", F.lit(5000))).collect()
    }
    assert ann.recall_at_k(some, exact).first().recall > 0.5


def test_plans(spark, skewed):
    rows, asks = skewed
    corpus, requests = frames(spark, rows, asks)
    plan = search.search_batch(corpus, requests)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
    blocks = search.search_block(corpus, requests)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in blocks and "NestedLoop" not in blocks and "SinglePartition" not in blocks
    top = search.search_topk(corpus, [0.1] * 24)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_ranking_is_cut_before_the_shuffle(spark):
    """With and without totals, and however many rows the tasks found for a request."""
    found = [(q, 0, i, float((i * 7919) % 1000), 1, 5) for q in (1, 2) for i in range(400)]
    partials = spark.createDataFrame(found, "query_id long, part int, id long, score double, matched long, top_k int").repartition(6)
    expected = {q: sorted(range(400), key=lambda i: (-((i * 7919) % 1000), i))[:5] for q in (1, 2)}
    for totals in (False, True):
        ranked = search._rank(partials, 5, totals)
        assert ranked._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
        rows = ranked.orderBy("query_id", "rank").collect()
        assert {q: [r.id for r in rows if r.query_id == q] for q in (1, 2)} == expected
        assert not totals or {r.total for r in rows} == {400}


def test_payload_is_read_from_the_winners_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BUCKET_IDS", 50)
    rows = [(i, [float(i == 7), 1.0], f"text {i}") for i in range(500)]
    corpus = search.with_id_bucket(spark.createDataFrame(rows, "id long, embedding array<float>, content string"))
    corpus.write.partitionBy("id_bucket").parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    asked = spark.createDataFrame([(1, [1.0, 1.0], 1, 0.99)], REQUESTS)
    found = search.search_batch(stored, asked, ["content"])
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.content) for r in found.collect()] == [(7, "text 7")]


def test_many_pairs_are_shared_out_in_blocks(spark, monkeypatch):
    """However few floats the requests have, no task scores all of them against a large corpus."""
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=8).round(3).tolist()) for i in range(900)]
    asks = [(i, v, 4, -0.5) for i, v in vectors[:300]]
    for name, value in (("SCAN_REQUESTS", 10), ("SCAN_PAIRS", 1000), ("BLOCK_ROWS", 100), ("REQUEST_BLOCK_ROWS", 50)):
        monkeypatch.setattr(search, name, value)
    for name, value in (("BLOCK_ROWS", 100), ("REQUEST_BLOCK_ROWS", 50)):
        monkeypatch.setattr(ann, name, value)
    corpus, requests = frames(spark, vectors, asks)
    expected, _ = brute(vectors, asks)
    found = search.search_batch(corpus, requests)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "REPARTITION_BY_NUM" in plan
    assert collected(found) == expected
    centroids = ann.train_cells(corpus, 3)
    every = ann.search_ann(settle(ann.assign_cells(corpus, centroids), "cells"), requests, centroids, probes=3)
    assert "FlatMapCoGroupsInArrow" in every._jdf.queryExecution().executedPlan().toString()
    assert collected(every) == expected


def test_cut_keeps_all_that_may_match():
    from quillvec.operators import scoring

    scores = np.array([[0.3, -np.inf, 0.29999998]], np.float32)
    low = scoring._bound(np.array([[0.3 - 1e-9]]), scores.dtype, -np.inf)
    assert low.dtype == np.float32 and (scores >= low).tolist() == [[True, False, True]]
    assert (scores >= scoring._bound(np.array([[-np.inf]]), scores.dtype, -np.inf)).tolist() == [[True, False, True]]
