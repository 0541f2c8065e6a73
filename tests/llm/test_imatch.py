import hashlib
import re
from collections import Counter

import xxhash

from pyspark.sql import functions as F

from quillvec.llm import imatch


def test_edited_text_follows_descending_ids(spark, tables):
    folder, plain = tables
    order = sorted(plain, key=lambda p: -p[0])
    expected = {}
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        expected[doc_id] = (len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest())
    found = imatch.query(spark, folder).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in found} == expected
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = {}
    text = {p[0]: p[1] or "" for p in plain}
    for r in found:
        assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def int_hash(value, seed=42):
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return {xxhash.xxh64_intdigest(t.encode(), 42) % 2**imatch.TERM_BITS for t in found}


def plain_print(text, lexicon):
    """The fingerprint of one text, subset by subset."""
    ids = plain_terms(text)
    kept = sorted(ids & lexicon) or sorted(ids) or [xxhash.xxh64_intdigest(text.encode(), 42) % 2**imatch.TERM_BITS]

    def hashed(terms):
        out = 42
        for t in terms:
            out = int_hash(t, out)
        return out

    subsets = []
    for draw in range(1, imatch.DRAWS + 1):
        for rate in range(1, imatch.RATES + 1):
            inside = [t for t in kept if int_hash(draw, int_hash(t)) % 2**rate == 0]
            subsets.append(hashed(inside) >> 32 if inside else 0)
    return hashed(kept), subsets


def plain_likeness(a, b):
    same = sum(x == y != 0 for x, y in zip(a[1], b[1]))
    return 1.0 if a == b else 1 - 2 ** (-same / imatch.DRAWS)


def test_fingerprints_match_plain_version(spark, tables):
    """Fingerprints and likenesses of the whole query against a text-by-text version."""
    folder, plain = tables
    order = sorted(plain, key=lambda p: -p[0])
    counts = Counter(t for _, text, *_ in plain for t in plain_terms(text or ""))
    low, high = max(2, imatch.LEAST_SHARE * len(plain)), max(2, imatch.MOST_SHARE * len(plain))
    lexicon = {t for t, n in counts.items() if low <= n <= high}
    assert lexicon

    def shown(print_):
        return f"{print_[0]:X}:" + ".".join(f"{h:X}" if h else "" for h in print_[1])

    expected = {}
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        prints = [plain_print(t, lexicon) for t in (text, text[: len(text) - cut] + after[:cut], after)]
        expected[doc_id] = (shown(prints[0]), shown(prints[1]), *(round(plain_likeness(prints[0], p), 9) for p in prints[1:]))
    found = imatch.query(spark, folder).collect()
    assert {
        r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found
    } == expected


def test_every_term_of_a_long_text_counts(spark):
    """Long texts that differ in a hundred of some thousands of terms, or in one; and a text beside its first quarter."""
    from tests.llm.conftest import prose

    # Without a band, all terms are hashed.
    base = list(dict.fromkeys(prose(1, 4000).split(" ")))[:3000]
    rows = [(0, " ".join(base)), (1, " ".join(base[:-1])), (2, " ".join(base[:750]))]
    rows += [(10 + i, " ".join(base[: 90 * i] + [f"new{i}x{k}" for k in range(100)] + base[90 * i + 100 :])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = F.array_repeat(F.lit(0).cast("long"), 2**imatch.TERM_BITS // 64)
    printed = imatch.with_fingerprint(docs, "text", "print", table)
    first = printed.where("doc_id = 0").select(F.col("print").alias("first"))
    found = {r["doc_id"]: r for r in printed.crossJoin(first).select("doc_id", imatch.as_string(F.col("print")).alias("p"), imatch.likeness(F.col("print"), F.col("first")).alias("near")).collect()}
    assert len({r["p"] for r in found.values()}) == len(rows)
    assert found[0]["near"] == 1 and found[1]["near"] > 0.95 and 0.05 < found[2]["near"] < 0.5
    assert all(0.75 < found[10 + i]["near"] < 1 for i in range(30))


def test_likeness_follows_shared_terms(spark):
    """The more lexicon terms two texts share, the more alike; unrelated ones hardly, equal ones wholly."""
    from tests.llm.conftest import prose

    words = prose(1, 3000).split(" ")
    rows = [(i, " ".join(words[(17 * i) % 2800 : (17 * i) % 2800 + 200])) for i in range(300)]
    frame = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    a = frame.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("x"))
    b = frame.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("y"))
    for shift, low, high in ((0, 1, 1), (1, 0.6, 1), (6, 0.1, 0.5), (60, 0, 0.1)):
        near = a.join(b, F.col("b") == F.col("a") + shift).where("b < 160").agg(F.avg(imatch.likeness(F.col("x"), F.col("y")))).first()[0]
        assert low <= near <= high


def test_odd_rows(spark, docs, rows, nothing):
    found = imatch.fingerprints(docs).collect()
    assert len(found) == len(rows)
    by_text = {}
    for r in found:
        by_text.setdefault(r["text"], set()).add(repr(r["fingerprint"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert imatch.fingerprints(nothing).count() == 0


def test_repeated_rows_come_back(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other"), (None, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").fillna({"text": ""})
    out = imatch.followed(docs).select("key.doc_id", "text", "times").collect()
    assert sorted(map(repr, out)) == sorted(map(repr, [
        type(out[0])(doc_id=1, text="a b c", times=2), type(out[0])(doc_id=1, text="other", times=1),
        type(out[0])(doc_id=None, text="x", times=1), type(out[0])(doc_id=None, text="", times=1),
    ]))
