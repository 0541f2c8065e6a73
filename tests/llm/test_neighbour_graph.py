import math

import numpy as np
import pytest

from quillvec.llm import neighbour_graph as g

SCHEMA = "vec_id long, embedding array<float>, label int, node long, block int, rank int"


def brute(rows, queries, k):
    """query_id -> [(vec_id, score)] by comparing with every row, nearest first, ties by id."""
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    lengths = [len(v) for _, v in usable]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    usable = [(i, v) for i, v in usable if len(v) == d]
    ids, x = np.array([i for i, _ in usable]), np.stack([v for _, v in usable])
    out = {}
    for i, v in usable:
        if i in queries:
            far = np.sqrt(((x - v) ** 2).sum(axis=1))
            rest = {(j, tuple(w)): (j, f) for j, w, f in zip(ids.tolist(), (x + 0.0).tolist(), far.tolist())}
            del rest[i, tuple((v + 0.0).tolist())]
            out[i] = sorted(rest.values(), key=lambda p: (p[1], p[0]))[:k]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def check(got, truth, least):
    hits = total = 0
    for q, near in truth.items():
        scores = [s for _, s in got[q]]
        assert len(got[q]) == len(near) == len(set(got[q]))
        assert scores == sorted(scores) and got[q] == sorted(got[q], key=lambda p: (p[1], p[0])) and (q, 0.0) not in got[q]
        hits += sum(s <= near[-1][1] * (1 + 1e-12) for s in scores)
        total += len(near)
    assert set(got) == set(truth)
    assert hits >= least * total


def vectors(n, d, seed):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(12, d))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(centers[draw.integers(0, 12, n)] + 0.6 * draw.normal(size=(n, d)))]


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("block", [8192, 200])
def test_recall_and_exact_scores(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(g, "BLOCK", block)
    rows = vectors(1500, 16, 1)
    # A third of all rows are one vector, some more are copies of others.
    rows += [(2000 + i, rows[0][1]) for i in range(700)] + [(2700 + i, rows[100 + i // 3][1]) for i in range(60)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = found(g.query(spark, str(tmp_path)))
    truth = brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    check(got, truth, 0.97)
    for q, near in got.items():
        exact = dict(truth[q])
        for i, s in near:
            assert i not in exact or s == pytest.approx(exact[i], rel=1e-12, abs=1e-15)
    # Among copies the smaller ids come first.
    assert got[2000] == [(0, 0.0)] + [(2001 + i, 0.0) for i in range(9)]


def test_odd_rows(spark, nothing):
    rows = vectors(60, 5, 2)
    good = list(rows)
    rows += [(100, None), (200, []), (300, [0.0] * 5), (400, [1.0, None, 1.0, 1.0, 1.0]), (500, [float("nan")] * 5), (600, [float("inf"), *[1.0] * 4])]
    rows += [(700, [1.0, 2.0]), (None, [1.0] * 5), rows[3], rows[3], (7, [0.5] * 5), (800, [-0.0, 1.0, 0.0, 0.0, 0.0]), (900, [0.0, 1.0, 0.0, 0.0, 0.0])]
    frame = table(spark, rows)
    graph = g.build(frame)
    queries = frame.withColumnRenamed("vec_id", "query_id").where("query_id % 100 = 0 or query_id in (3, 8)")
    got = found(g.search(graph, queries, 10))
    assert set(got) == {0, 3, 8, 800, 900}
    check(got, brute(rows, {0, 3, 8, 800, 900}, 10), 0.99)
    assert got[800][0] == (900, 0.0)
    # A query that is no row of the graph, and fewer candidates than asked for.
    far = spark.createDataFrame([(-5, [9.0, 9.0, 9.0, 9.0, 9.0]), (0, None)], "query_id long, embedding array<float>")
    near = found(g.search(graph, far, 3))
    x = [(i, math.dist(v, [9.0] * 5)) for i, v in [*good, (7, [0.5] * 5), (800, [0, 1.0, 0, 0, 0]), (900, [0, 1.0, 0, 0, 0])]]
    assert [i for i, _ in near[-5]] == [i for i, _ in sorted(x, key=lambda p: (p[1], p[0]))[:3]]
    few = g.build(table(spark, rows[:4]))
    assert {q: len(n) for q, n in found(g.search(few, queries, 10)).items()} == {0: 3, 3: 3, 8: 4, 800: 4, 900: 4}


def test_nothing_to_search(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert g.build(none) is None
    assert g.build(table(spark, [(1, None), (2, [0.0, 0.0])])) is None
    none.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert g.query(spark, str(tmp_path)).count() == 0
    one = g.build(table(spark, [(1, [1.0, 2.0])]))
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "query_id long, embedding array<float>")
    assert found(g.search(one, queries, 10)) == {2: [(1, 0.0)]}


def test_trees_split_evenly():
    x = np.random.default_rng(1).normal(size=(4000, 8)).astype(np.float32)
    tree = g.grow(x, 64, 0)
    sizes = np.bincount(tree.leaves(x), minlength=len(tree.centers))
    assert sizes.min() >= 25 and sizes.max() <= 64 and len(sizes) == len(tree.centers)
    same = g.grow(np.ones((100, 3), dtype=np.float32), 8, 0)
    assert len(same.centers) == 1 and (same.leaves(np.ones((5, 3), dtype=np.float32)) == 0).all()


def test_local_join_finds_all_nearer_pairs():
    """Against every pair of a node's neighbours with a new one among them."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(80, 4)).astype(np.float32)
    at, u, fresh = [], [], []
    for v in range(20):
        some = draw.choice(80, 9, replace=False)
        at += [v] * 9
        u += some.tolist()
        fresh += (draw.random(9) < 0.4).tolist()
    import pyarrow as pa

    edges = pa.table({"block": [0] * len(at), "at": at, "u": u, "fresh": fresh, "back": [False] * len(at)})
    radius = np.full(80, 3.0, dtype=np.float32)
    vectors = pa.table({"block": [0] * 80, "u": list(range(80)), "v": g.blobs(x), "radius": radius})
    got = g.compare_neighbours("<f4", 4, 1000, 10, 1)(edges, vectors).to_pylist()
    expected = set()
    for v in range(20):
        own = [(b, f) for a, b, f in zip(at, u, fresh) if a == v]
        expected |= {(a, b) for a, f in own for b, h in own if a != b and (f or h) and ((x[a] - x[b]) ** 2).sum() < 3}
    assert {(r["target"], r["cand"]) for r in got} == expected and len(got) == len(expected)
