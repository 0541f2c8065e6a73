import hashlib
import re

import pytest

from quillvec.llm import winnowing

ITEMS = "item_id long, text string, key string, span int"


def split(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(rows, items):
    windows = set()
    for item, text, *_ in items:
        w = split(text)
        span = min(len(w), 10)
        if span and item is not None:
            windows.update((tuple(w[i : i + span]), str(item)) for i in range(len(w) - span + 1))
    by_gram = {}
    for gram, item in windows:
        by_gram.setdefault(gram, set()).add(item)
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = split(text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                for item in by_gram.get(tuple(w[i : i + n]), ()):
                    hit.update(range(i, i + n))
                    found.add(item)
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(rows):
    base = rows[0][1].split(" ")
    return [
        (1, " ".join(base[20:45]), "x", 1), (2, " ".join(base[30:41]).upper(), "x", 1), (3, " ".join(base[:10]), "x", 1),
        (4, "one", None, None), (5, "one two", "x", 1), (6, "a a a a a a a a a a a", "x", 1), (7, None, "x", 1), (8, "", "x", 1),
        (9, "not in there at all, though it has more than ten words in a row", "x", 1), (5, "wörds — ÇA", "x", 1),
        (10, " ".join(rows[22][1].split(" ")[5000:9000]), "x", 1), (None, rows[6][1], "x", 1), (1, " ".join(base[20:45]), "x", 1),
        (11, "34 56", "x", 1),
    ]


def rows_of(frame):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in frame.select(*cols).collect()), key=repr)


def test_spans_match_brute_force(spark, docs, rows, items):
    found = winnowing.contamination(docs, spark.createDataFrame(items, ITEMS))
    assert rows_of(found) == brute(rows, items)


def test_every_shared_span_of_ten_words_is_found(spark):
    """Spans of 10 to 14 words at all ends of items and documents."""
    from tests.llm.conftest import prose

    item = prose(70, 30)
    w = item.split(" ")
    rows = [(100 * n + s, " ".join([*prose(80 + s, s % 4).split(), *w[s : s + n], *prose(90 + s, n % 3).split()])) for n in (9, 10, 11, 14) for s in range(17)]
    found = winnowing.contamination(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    )
    assert rows_of(found) == brute(rows, [(1, item)])


def test_empty_tables(spark, docs, rows, nothing):
    none = spark.createDataFrame([], ITEMS)
    assert rows_of(winnowing.contamination(docs, none)) == brute(rows, [])
    assert winnowing.contamination(nothing, none).count() == 0


def test_stage_drops_leaks_only(spark, tables):
    folder, plain = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = winnowing.stage(spark, docs, folder)
    expected = brute(plain, [(1, plain[0][1]), (2, "nothing of it anywhere in there at all no not ever"), (4, "one two")])
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in expected if not r[5])


def test_stage_judges_rows_without_doc_id_by_their_texts(spark, docs, rows, nothing, tables):
    folder, plain = tables
    leak = plain[0][1]
    odd = docs.unionByName(spark.createDataFrame([(None, "before " + leak, "en"), (None, "before " + leak, "en"), (None, "clean words", "en")], "doc_id long, text string, lang string"), allowMissingColumns=True)
    given = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, leak), (2, "nothing of it anywhere in there at all no not ever"), (4, "one two")]
    bad = {r[0] for r in brute([x for x in given if x[0] is not None], items) if r[5]}
    loose = [x for x in given if x[0] is None and not brute([x], items)[0][5]]
    kept = winnowing.stage(spark, odd, folder)
    assert kept.columns == odd.columns
    found = sorted(repr((r["doc_id"], r["text"])) for r in kept.collect())
    assert found == sorted(repr(x) for x in [x for x in given if x[0] is not None and x[0] not in bad] + loose) and len(loose) == 3
    assert winnowing.stage(spark, nothing, folder).count() == 0


def test_a_common_opening_makes_no_alignments(spark, monkeypatch):
    """Nine words shared by all items and documents; and ten, in one document."""
    from tests.llm.conftest import prose

    opening = prose(60, 9)
    items = [(i, f"{opening} {prose(1000 + i, 12)}") for i in range(60)]
    rows = [(i, f"{prose(3000 + i, 5)} {opening} {prose(5000 + i, 20)}") for i in range(200)] + [(900, "x " + items[7][1])]
    made, settle = {}, winnowing.settle
    monkeypatch.setattr(winnowing, "settle", lambda df, label: made.setdefault(label, settle(df, label)))
    found = winnowing.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found) == brute(rows, items)
    # The opening alone, which all share, aligns nothing: no alignment but of a document with an item it is hit by.
    assert made["aligned"].count() == sum(r["n_items"] for r in found.collect()) < 10
