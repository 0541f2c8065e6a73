import pytest
from pyspark.sql import functions as F

from quillvec.llm import mixing
from quillvec.llm.mixing import mix, water_fill, word_count


def plain_targets(sizes, weights, cap):
    """Clamp and share again until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s] + 1e-9]
        if not above:
            return held | share
        held |= {s: cap * sizes[s] for s in above}


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 3, "d": 500, None: 40, "e": 0}
    rows = [(s, n, w) for (s, n), w in zip(sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or "")), [5, 2, 1, 5, 2, 1])]
    found = {r["source"]: r["target"] for r in water_fill(spark.createDataFrame(rows, "source string, source_size long, weight int")).collect()}
    expected = plain_targets(sizes, [5, 2, 1], 3)
    assert {s: round(t, 6) for s, t in found.items()} == {s: round(t, 6) for s, t in expected.items()}


def test_word_count(spark, docs):
    import re

    for r in docs.select("text", word_count(docs["text"]).alias("n")).collect():
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))


def test_mix_takes_whole_rows_near_the_targets(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", (7 * i) % 50 + (2000 if i == 10 else 1)) for i in range(600)] + [(900, None, 5), (901, "zero", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, n long").repartition(4)
    found = mix(frame, "doc_id", frame["source"], frame["n"]).collect()
    again = mix(frame.repartition(2), "doc_id", frame["source"], frame["n"]).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)
    taken, sizes, smallest = {}, {}, {}
    for r in found:
        assert 0 <= r["repeats"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["repeats"] * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        smallest[r["source"]] = max(smallest.get(r["source"], 0), r["size"] if r["size"] < 100 else 0)
    targets = plain_targets(sizes, mixing.WEIGHTS, 3)
    for r in found:
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    for s, t in targets.items():
        assert t - smallest[s] - 1e-6 <= taken[s] <= t + 1e-6


@pytest.mark.parametrize("tail", [mixing.TAIL_ROWS, 0])
def test_a_long_row_early_in_the_draw_shuts_no_later_row_out(spark, monkeypatch, tail):
    """Every source takes what a plain walk over its rows in the seeded order takes."""
    monkeypatch.setattr(mixing, "TAIL_ROWS", tail)
    draw = F.xxhash64(F.lit(mixing.SEED), "id", "n")
    first = spark.range(1000, 9000).withColumn("n", F.lit(60_000).cast("long")).orderBy(draw).first()["id"]
    rows = [(first, "a", 60_000)] + [(i, "a", 50 * (1 + (7 * i) % 6)) for i in range(500)]
    rows += [(500 + i, None if i % 2 else "b", 1 + (31 * i) % 97) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, source string, n long").repartition(6)
    found = mix(frame, "id", frame["source"], frame["n"], weights=[1, 4, 3], max_epochs=10).collect()
    assert sorted(r["id"] for r in found) == sorted(r[0] for r in rows)
    repeats = {r["id"]: r["repeats"] for r in found}
    order = [r["id"] for r in frame.orderBy(draw, "id").collect()]
    size, source = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    assert [i for i in order if source[i] == "a"][0] == first
    gap, whole = {}, {}
    for r in found:
        whole[r["source"]] = int(r["target"] / r["source_size"] + 1e-12)
        gap[r["source"]] = r["target"] - whole[r["source"]] * r["source_size"]
    assert 10_000 < gap["a"] < 60_000
    for i in order:
        takes = size[i] <= gap[source[i]] + 1e-6
        gap[source[i]] -= size[i] * takes
        assert repeats[i] == whole[source[i]] + takes
    assert gap["a"] < 50


def test_odd_rows(spark, docs, rows, nothing):
    found = mix(docs, "doc_id", docs["source"], word_count(docs["text"])).collect()
    assert len(found) == len(rows)
    assert mix(nothing, "doc_id", nothing["source"], word_count(nothing["text"])).count() == 0


def test_stage_repeats_rows(spark, tables):
    folder, plain = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = mixing.stage(spark, docs, folder)
    assert out.columns == docs.columns
    repeats = {r["doc_id"]: r["repeats"] for r in mixing.query(spark, folder).collect()}
    ids = [r["doc_id"] for r in out.collect()]
    assert {i: ids.count(i) for i in repeats} == repeats
