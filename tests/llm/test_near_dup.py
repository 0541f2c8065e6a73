from quillvec.llm import near_dup
from quillvec.llm.components import components


def plain_sets(rows):
    """doc_id -> sets of its texts, by the rules of the query."""
    sets = {}
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        s = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(s)
    return sets


def plain_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_classes_match_all_pairs(docs, rows):
    found = near_dup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    expected = plain_components(plain_sets(rows))
    sizes = {(i, len(s)) for i, ss in plain_sets(rows).items() for s in ss}
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
            assert (r["doc_id"], r["n_shingles"]) in sizes


def test_a_crowd_of_heavily_edited_copies(spark):
    """Copies of one text, many of which link with some but not with the center."""
    import random

    from tests.llm.conftest import edited, prose

    base, draw = prose(50, 100), random.Random(5)
    rows = [(i, edited(base, sorted(draw.sample(range(100), draw.randint(0, 6))))) for i in range(150)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_components(plain_sets(rows))


def test_empty_table(nothing):
    assert near_dup.near_duplicates(nothing).count() == 0
    assert near_dup.stage(nothing.sparkSession, nothing, "").count() == 0


def test_stage_keeps_one_row_of_each_class(spark, docs, rows):
    kept = near_dup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    expected = plain_components(plain_sets(rows))
    ids = [r["doc_id"] for r in kept.collect()]
    with_id = [i for i in ids if i is not None]
    assert sorted(set(with_id)) == sorted(set(expected.values()))
    # Only a doc_id with two different texts stays twice.
    assert sorted(i for i in set(with_id) if with_id.count(i) > 1) == [i for i in (9,) if expected[9] == 9]
    assert ids.count(None) == 2


def test_bounds_give_up_only_hopeless_pairs():
    bounds = dict(near_dup.least_matches())
    assert bounds[32] < 24 < 32 and bounds[160] < 120
    assert bounds[160] > 80


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    frame = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(frame).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(frame.limit(0)).count() == 0
