import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.llm import language_id as lang


def plain_grams(text):
    """Buckets of one text's n-grams, one by one."""
    padded, out = " " + text + " " * (max(lang.GRAMS) - 1), []
    for i in range(len(text) + 1):
        for n in lang.GRAMS:
            factors = [int(f) for f in lang.odd_numbers(n, 61 + n)]
            value = sum(ord(c) * f for c, f in zip(padded[i : i + n], factors)) % 2**64
            out.append(int(lang.mixed(np.array([value], dtype=np.uint64))[0]) >> (64 - lang.HASH_BITS))
    return out


def test_batches_equal_single_texts():
    texts = ["abc", "", "été à la", "x", "straße groß"]
    buckets, starts = lang.gram_batch(texts)
    for i, t in enumerate(texts):
        end = starts[i + 1] if i + 1 < len(texts) else len(buckets)
        assert buckets[starts[i] : end].tolist() == plain_grams(t)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, lang.train(docs, ~lang.held_out())


def test_held_out_accuracy(spark, model):
    docs, parts = model
    found = lang.identify(docs, parts).join(docs.select("doc_id", "lang"), "doc_id").where(lang.held_out())
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_scores_are_posteriors(spark, model):
    _, parts = model
    names, prior, matrix = parts.names, parts.prior, parts.matrix()
    texts = ["the", "Der", "été", "niño 12", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in lang.identify(rows, parts).collect()}
    for i, t in enumerate(texts):
        logs = prior + sum(matrix[b].astype(float) for b in plain_grams(lang.plain(t)))
        chance = np.exp(logs - logs.max())
        chance /= chance.sum()
        assert found[i]["lang_pred"] == names[int(chance.argmax())]
        assert math.isclose(found[i]["score"], chance.max(), rel_tol=1e-4)


def test_odd_rows(spark, docs, rows, nothing, model):
    _, parts = model
    found = lang.identify(docs, parts).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for doc_id, text, *_ in rows[:-4]:
        known = any(c.isalpha() for c in text or "")
        assert (by_id[doc_id]["lang_pred"] == "und") == (not known) and 0 <= by_id[doc_id]["score"] <= 1
    assert lang.identify(nothing, parts).count() == 0
    untaught = lang.identify(docs, lang.train(nothing, F.lit(True)))
    assert {(r["lang_pred"], r["score"]) for r in untaught.collect()} == {("und", 0.0)}


def test_matrix_is_smoothed_counts(spark):
    docs = spark.createDataFrame([(1, "ab a", "x"), (2, "ab", "x"), (3, "zé", "y"), (4, "ab", None), (5, None, "z")], "doc_id long, text string, lang string")
    parts = lang.train(docs, F.lit(True))
    assert parts.names == ["x", "y"]
    counts = np.full((1 << lang.HASH_BITS, 2), lang.SMOOTHING)
    for text, at in (("ab a", 0), ("ab", 0), ("zé", 1)):
        for bucket in plain_grams(text):
            counts[bucket, at] += 1
    assert np.allclose(parts.matrix(), np.log(counts / counts.sum(axis=0)), atol=1e-5)
    assert np.allclose(parts.prior, np.log([2 / 3, 1 / 3]))


def test_more_languages_than_a_block(spark):
    """600 languages of a word each: all are learnt, blocks give what one block gives, ties go to the first name."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) * 3 for k in range(3))
    rows = [(3 * i + k, f"{word(i)} {word(i)}", f"l{i:03d}") for i in range(600) for k in range(2)]
    rows += [(5000, "same words", "ta"), (5001, "same words", "tb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parts = lang.train(docs, F.lit(True))
    assert len(parts.names) == 602
    found = {r["doc_id"]: r for r in lang.identify(docs, parts).collect()}
    assert all(found[i]["lang_pred"] == name for i, _, name in rows[:-2])
    assert found[5000]["lang_pred"] == found[5001]["lang_pred"] == "ta"
    one = {r["doc_id"]: r for r in lang.identify(docs.where("doc_id % 10 = 0"), parts, block=1000).collect()}
    for i, r in one.items():
        assert r["lang_pred"] == found[i]["lang_pred"] and math.isclose(r["score"], found[i]["score"], rel_tol=1e-9)


def test_query(spark, tables):
    folder, plain = tables
    assert sorted(r["doc_id"] for r in lang.query(spark, folder).collect()) == sorted(p[0] for p in plain)
