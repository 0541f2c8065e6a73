import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillvec.functions import cells, encode, text
from quillvec.functions.chunker import split_text
from quillvec.operators import chunks


def s(value):
    return F.lit(value).cast("string")


def slow_split(body, size, overlap, marks):
    """The chunking rules, written down step by step for small texts."""
    index = next(i for i, m in enumerate(marks) if m == "" or m in body)
    mark, finer = marks[index], marks[index + 1 :]
    pieces, at = [], 0
    if mark == "":
        pieces = list(body)
    else:
        while True:
            nxt = body.find(mark, at + (len(mark) if pieces or at else 0)) if at or pieces else body.find(mark)
            if nxt == -1:
                pieces.append(body[at:])
                break
            pieces.append(body[at:nxt])
            at = nxt
            following = body.find(mark, at + len(mark))
            while following != -1:
                pieces.append(body[at:following])
                at = following
                following = body.find(mark, at + len(mark))
            pieces.append(body[at:])
            break
    pieces = [p for p in pieces if p]

    def merge(parts):
        out, current = [], []
        for part in parts:
            if current and sum(map(len, current)) + len(part) > size:
                out.append("".join(current).strip())
                while current and (sum(map(len, current)) > overlap or sum(map(len, current)) + len(part) > size):
                    current = current[1:]
            current = current + [part]
        return out + (["".join(current).strip()] if current else [])

    out, short = [], []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
        else:
            out += merge(short)
            short = []
            out += slow_split(piece, size, overlap, finer) if finer else [piece.strip()]
    return [c for c in out + merge(short) if c]


MARKS = ["\n\n", "\n", ". ", " ", ""]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\né", max_size=120), st.integers(5, 20), st.integers(0, 4))
def test_chunker_follows_the_rules(body, size, overlap):
    expected = slow_split(body, size, overlap, MARKS) if body else []
    assert split_text(body, size, overlap, MARKS) == expected


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc .\n😀", max_size=400), st.integers(8, 40), st.integers(0, 7))
def test_chunker_invariants(body, size, overlap):
    out = split_text(body, size, overlap, MARKS)
    assert all(chunk.strip() == chunk and 0 < len(chunk) <= size for chunk in out)
    at = 0
    for letter in (c for c in body if not c.isspace()):
        assert any(letter in chunk for chunk in out)
    for chunk in out:
        assert chunk in body
        assert body.find(chunk, 0) >= 0
        at += 1


def test_chunker_examples():
    assert split_text("") == [] and split_text("  \n ") == []
    assert split_text("one two", 100, 10) == ["one two"]
    assert split_text("aaaa\n\nbbbb\n\ncccc", 10, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert split_text("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    assert split_text("x" * 10, 10, 2) == ["x" * 10]


def fixed(body, size, overlap):
    return [body[i : i + size] for i in range(0, max(len(body) - overlap, 1), size - overlap)] if body else []


def test_chunk_fixed_matches_slices(spark):
    random.seed(5)
    bodies = ["", "a", "é" * 9, "😀b" * 40] + ["".join(random.choices("ab\n😀é ", k=n)) for n in range(1, 90)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, t string")
    for size, overlap in [(10, 0), (10, 3), (10, 5), (10, 8), (7, 6)]:
        got = {r.i: r.c for r in df.select("i", text.chunk_fixed(F.col("t"), size, overlap).alias("c")).collect()}
        assert got == {i: fixed(b, size, overlap) for i, b in enumerate(bodies)}
    with pytest.raises(ValueError):
        text.chunk_fixed(F.col("t"), 10, 10)


def test_numbered_chunks(spark):
    pages = spark.createDataFrame(
        [("b.pdf", 0, "x" * 25), ("a.pdf", 1, "   "), ("a.pdf", 0, "hello world"), ("a.pdf", 2, None)],
        "file_name string, page int, text string",
    )
    rows = chunks.chunk_metadata(pages, "fixed", size=10, overlap=2).orderBy("chunk_index").collect()
    # The blank page takes number 2 and is not kept.
    assert [(r.file_name, r.page_number, r.pos, r.chunk_index) for r in rows] == [
        ("a.pdf", 0, 0, 0), ("a.pdf", 0, 1, 1), ("b.pdf", 0, 0, 3), ("b.pdf", 0, 1, 4), ("b.pdf", 0, 2, 5),
    ]
    assert chunks.chunk_pages(pages, "recursive", 10, 2).count() == 5


def test_names(one_row):
    r = one_row(
        a=text.table_name_from_file(s("/data/My file-2.xlsx")),
        b=text.table_name_from_file(s("plain"), "pre"),
        c=text.table_name_from_file(s("C:\\x\\two.parts.csv")),
        d=text.file_name_of(s("data/sub/doc.pdf")),
        e=text.file_name_of(s(None)),
        f=text.file_name_of(s("data/")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("My_file_2", "pre_plain", "two.parts", "doc.pdf", "unknown", "unknown")


def test_preview_lengths(one_row):
    r = one_row(**{f"p{n}": text.preview(s("é" * n), 200) for n in (0, 200, 201)}, none=text.preview(s(None), 200))
    assert (r.p0, r.p200, r.p201, r.none) == ("", "é" * 200, "é" * 200 + "...", None)


def test_combined_and_context(spark):
    df = spark.createDataFrame(
        [(" a\n", "b", None), ("  ", None, None), (None, "\u00a0", "z")], "`Tên` string, y string, z string"
    )
    assert [r[0] for r in df.select(text.combined_text(["Tên", "y", "z"])).collect()] == ["Tên: a | y: b", "", "z: z"]
    products = spark.createDataFrame(
        [("Pump", "Tools", " ", 1234.5), (None, None, None, None), ("A", None, "d", -2.0)],
        "n string, c string, d string, p double",
    )
    price = F.col("p").cast("decimal(18,2)")
    context = text.full_text_context(F.col("n"), F.col("c"), F.col("d"), price)
    assert [r[0] for r in products.select(context).collect()] == [
        "Product: Pump. Category: Tools. Price: $1,234.50.", ".", "Product: A. Description: d. Price: -$2.00.",
    ]


def test_encoders_agree_and_stay_aligned(spark):
    rows = [(0, "Hello  hello world"), (1, "  "), (2, None), (3, "ünïcode\ttext\n"), (4, "one")]
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)
    out = df.select(
        "i",
        encode.hashed_vector(F.col("t"), 32).alias("a"),
        encode.vectorize(F.col("t"), encode.hashed_encoder(32), 2).alias("b"),
    ).collect()
    got = {r.i: r for r in out}
    assert got[1].a is None and got[1].b is None and got[2].a is None and got[2].b is None
    for i in (0, 3, 4):
        assert got[i].a == pytest.approx(got[i].b) and len(got[i].a) == 32
        assert sum(x * x for x in got[i].a) == pytest.approx(1.0)


def test_isolated_failures(spark):
    def fragile():
        inner = encode.hashed_encoder(16)()

        def run(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no vector")
            return inner(texts)

        return run

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"text {i}") for i in range(7)] + [(9, None)], "i int, t string")
    out = {r.i: r.r for r in df.select("i", encode.vectorize_isolated(F.col("t"), fragile, 4).alias("r")).collect()}
    assert out[3].vector == [] and out[3].error == "RuntimeError: no vector"
    assert all(len(out[i].vector) == 16 and out[i].error is None for i in (0, 1, 2, 4, 5, 6))
    assert out[9].vector is None
    with pytest.raises(Exception, match="no vector"):
        df.select(encode.vectorize_isolated(F.col("t"), fragile, 4, "raise")).collect()


def test_encoder_runs_once_per_row(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("t")).select(encode.hashed_vector(F.col("t"), 8).alias("v"))
    plan = df.filter("size(v) > 0").filter("v[0] >= 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_cells(one_row):
    r = one_row(
        trunc=cells.to_int(F.lit(3.9), "double"), neg=cells.to_int(F.lit(-3.9), "double"),
        frac=cells.to_int(s("3.5"), "string"), good=cells.to_int(s(" 42 "), "string"), word=cells.to_int(s("x"), "string"),
        money=cells.to_decimal(s("1,234.5"), "string").cast("string"), junk=cells.to_decimal(s("n/a"), "string"),
        day=cells.to_timestamp(s("2024-02-30"), "string"), iso=cells.to_timestamp(s("2024-02-28T01:02:03"), "string").cast("string"),
        slash=cells.to_timestamp(s("31/12/2023"), "string").cast("string"),
        month_first=cells.to_timestamp(s("03/04/2023"), "string").cast("string"),
        bare=cells.to_timestamp(s("20240102"), "string"),
        micro=cells.to_timestamp(s("2024-02-28 01:02:03.123456"), "string").cast("string"),
        dbl=cells.to_double(s("x1")), owed=cells.to_decimal(s("(5.25)"), "string").cast("string"),
        short=cells.to_timestamp(s("5/7/2023"), "string").cast("string"),
        named=cells.to_timestamp(s("Mar 9, 2021"), "string").cast("string"),
        minus=cells.to_decimal(s(" 1,005- "), "string").cast("string"),
    )
    assert (r.trunc, r.neg, r.frac, r.good, r.word) == (3, -3, None, 42, None)
    assert r.money == "1234.50" and r.junk is None
    assert r.day is None and r.bare is None and r.dbl is None
    assert (r.owed, r.minus) == ("-5.25", "-1005.00")
    assert (r.short, r.named) == ("2023-05-07 00:00:00", "2021-03-09 00:00:00")
    assert r.iso == "2024-02-28 01:02:03" and r.slash == "2023-12-31 00:00:00"
    assert r.month_first == "2023-03-04 00:00:00" and r.micro == "2024-02-28 01:02:03.123456"


def test_texts_leave_the_task_in_small_pieces(spark, monkeypatch):
    """However long an Arrow batch is, few of its pages are cut and few of its rows made dense at a time."""
    from quillvec.functions import chunker, encode

    made = {}

    def noted(kind):
        def wrap(function):
            made[str(kind)] = function
            return real(kind)(function)

        return wrap

    real = F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", noted)
    chunker.chunk_recursive(F.col("text"), 300, 20)
    encode.hashed_vector(F.col("text"), 8)
    monkeypatch.undo()
    cut, dense = made.values()
    pages = ["some words. " * (i % 50) for i in range(1000)] + [None, ""]
    pieces = [p.to_pylist() for p in cut(iter([pa.array(pages)]))]
    assert max(map(len, pieces)) <= chunker.PAGES_AT_ONCE
    assert [c for p in pieces for c in p] == [chunker.split_text(p, 300, 20) if p else [] for p in pages]
    buckets = [[i % 8] * (i % 5) for i in range(2000)] + [None]
    rows = [p.to_pylist() for p in dense(iter([pa.array(buckets, pa.list_(pa.int32()))]))]
    assert max(map(len, rows)) <= encode.ROWS_AT_ONCE
    assert [r for p in rows for r in p] == [[float(bool(b) and j == b[0]) for j in range(8)] for b in buckets]
