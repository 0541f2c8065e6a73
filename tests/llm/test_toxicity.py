import numpy as np
from pyspark.sql import functions as F

from quillvec.llm import toxicity as t
from tests.llm.conftest import prose


def corpus(n, seed):
    """A row is toxic if it holds both an insult and a group's name; either alone is harmless."""
    draw, rows, labels = np.random.default_rng(seed), [], []
    for i in range(n):
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        words = prose(1000 * seed + i, 30).split(" ")
        words[3] = "zzinsult" if insult else words[3]
        words[17] = "zzgroup" if group else words[17]
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_pairs_are_learnt(spark):
    rows, labels = corpus(1500, 1)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = t.train(docs, marks, ~t.held_out())
    scores = {r["doc_id"]: r["score"] for r in t.toxicity(docs, machine).collect()}
    held = {r["doc_id"] for r in docs.where(t.held_out()).select("doc_id").collect()}
    right = [int(scores[i] >= t.THRESHOLD) == toxic for i, toxic in labels if i in held]
    assert len(right) > 250 and np.mean(right) > 0.98
    # The same rows in another order give the same model.
    again = t.train(docs.repartition(7), marks, ~t.held_out())
    assert np.allclose(again.weights, machine.weights) and np.allclose(again.factors, machine.factors)


def test_score_is_the_formula(spark):
    draw = np.random.default_rng(3)
    wanted = sorted({x for w in (b"alpha", b"beta", b"gamma") for x in t.word_terms(w)})
    machine = t.Machine(np.array(wanted), -0.3, draw.normal(size=len(wanted)), draw.normal(size=(len(wanted), 4)))
    texts = [(1, "Alpha beta; BETA"), (2, "gamma"), (3, None), (4, ""), (5, "alpha " * 20000), (None, "beta"), (1, "Alpha beta; BETA")]
    found = t.toxicity(spark.createDataFrame(texts, "doc_id long, text string"), machine).collect()
    expected = sorted((repr(i), round(plain_score(x, machine), 9)) for i, x in texts)
    assert sorted((repr(r["doc_id"]), round(r["score"], 9)) for r in found) == expected


def plain_score(text, machine):
    places = {int(h): i for i, h in enumerate(machine.terms)}
    held = {places[h] for w in t.WORD.findall((text or "").lower().encode()) for h in t.word_terms(w) if h in places}
    raw = machine.bias + sum(machine.weights[i] for i in held)
    raw += sum(machine.factors[i] @ machine.factors[j] for i in held for j in held if i < j)
    return 1 / (1 + np.exp(-raw))


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    scored = t.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rows = scored.select("score", "predicted", "toxic").collect()
    toxic = [r["score"] for r in rows if r["toxic"]]
    clean = [r["score"] for r in rows if not r["toxic"]]
    assert np.mean([np.mean([a > b for b in clean]) for a in toxic]) > 0.95
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(clean)
    assert sum(r["predicted"] for r in rows if r["toxic"]) >= 0.75 * len(toxic)


def test_labels_are_read_from_allowed_rows_only(spark):
    rows, labels = corpus(400, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = marks.withColumn("toxic", F.when(t.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = t.train(docs, marks, ~t.held_out()), t.train(docs, flipped, ~t.held_out())
    assert (a.terms == b.terms).all() and np.allclose(a.weights, b.weights)


def test_odd_rows(spark, docs, rows, nothing, tables):
    folder, plain = tables
    none = spark.createDataFrame([], "doc_id long, toxic int")
    blank = t.train(docs, none, ~t.held_out())
    assert {round(r["score"], 6) for r in t.toxicity(docs, blank).collect()} == {0.001}
    odd = spark.createDataFrame([(0, 1), (0, None), (None, 1), (3, 0), (777, 1)], "doc_id long, toxic int")
    assert t.toxicity(docs, t.train(docs, odd, F.lit(True))).count() == len(rows)
    assert t.toxicity(nothing, t.train(nothing, none, F.lit(True))).count() == 0
    out = t.query(spark, folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(p[0] for p in plain)
    kept = t.stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if not r["predicted"]}


def test_stage_judges_rows_without_doc_id_by_their_texts(spark, nothing, tmp_path):
    rows, labels = corpus(400, 2)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    marked = dict(labels)
    bad = max((r for r in rows if marked[r[0]]), key=lambda r: r[0])[1]
    loose = [(None, bad), (None, bad), (None, "a clean text of plain words"), (None, "a clean text of plain words"), (None, None), (7000, bad)]
    docs = spark.createDataFrame([(a, b, 1.0, "x") for a, b in [*rows, *loose]], "doc_id long, text string, score double, own_key string")
    kept = t.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    machine = t.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), ~t.held_out())
    texts = spark.createDataFrame(list(enumerate([bad, "a clean text of plain words", ""])), "doc_id long, text string")
    judged = {r["doc_id"]: r["score"] >= t.THRESHOLD for r in t.toxicity(texts, machine).collect()}
    assert judged == {0: True, 1: False, 2: False}
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(repr(x) for x in left if x[0] is None) == sorted(map(repr, loose[2:5])) and 7000 not in {x[0] for x in left}
    empty = t.stage(spark, nothing, str(tmp_path))
    assert empty.count() == 0 and empty.columns == nothing.columns
