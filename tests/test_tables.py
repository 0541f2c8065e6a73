import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillvec import constants as const
from quillvec.operators import clean, ids, present, stats
from quillvec.operators.ids import assign_ids, next_id
from quillvec.plans import load
from quillvec.plans.answer import answer_prompts
from quillvec.sources import readers, sinks
from quillvec.streaming.ingest import corpus_of_pages, ingest_incremental


def test_sheet_cleaning(spark):
    wide = ", ".join(f"c{i} string" for i in range(30))
    full = ["v"] * 30
    two = ["v", "v"] + [None] * 28
    rows = [tuple(full[:29] + [None]), tuple(two), tuple([None] * 30), tuple(["v"] * 3 + [None] * 27)]
    df = spark.createDataFrame(rows, wide)
    assert clean.drop_empty_rows(df).count() == 3
    assert clean.drop_sparse_rows(df).count() == 2
    kept = clean.drop_empty_columns(clean.drop_sparse_rows(df))
    assert len(kept.columns) == 29
    assert clean.min_cells(5) == 3 and clean.min_cells(59) == 5
    assert clean.drop_low_density(df, ["c0", "c29"]).count() == 3
    assert clean.drop_low_density(df, []).count() == 0


def test_names_are_repaired():
    assert clean.normalized_names(["a", None, "", "Unnamed: 3", "nan", "a", "a"]) == [
        "a", "Column_1", "Column_2", "Column_3", "Column_4", "a_2", "a_3",
    ]
    assert clean.normalized_names(["Name", "Name_2", "Name", "name"]) == ["Name", "Name_2", "Name_3", "name_4"]
    assert clean.normalized_names(["b", "B", "b_2", "Column_3", ""]) == ["b", "B_3", "b_2", "Column_3", "Column_4"]


def test_roles(spark):
    rows = [
        (i, i, "2024-01-0%d" % (i % 9 + 1) if i % 2 else "no date here", "long enough words", "abc", 1.5, True, None, "12345678")
        for i in range(30)
    ]
    df = spark.createDataFrame(
        rows,
        "row_index long, stt int, half string, prose string, short string, price double, flag boolean, dead string, digits string",
    ).withColumn("at", F.current_timestamp())
    roles = clean.infer_column_roles(df)
    # Exactly half of the sample parses as a date, which is not more than half.
    assert roles.text == ["half", "prose"]
    assert roles.numeric == ["price", "flag"] and roles.datetime == ["at"]
    assert roles.ignored == ["stt", "short", "dead", "digits"]
    assert "short" in clean.infer_column_roles(df, keep_short=True).text
    typed = clean.coerce_by_role(df, roles, ["row_index"])
    assert dict(typed.dtypes)["flag"] == "double" and typed.columns[0] == "row_index"


def test_roles_come_from_all_values(spark):
    rows = [(i, "ab" if i < 900 else "a sentence at the end", "2024-01-01" if i < 400 else "words, not a date") for i in range(1000)]
    df = spark.createDataFrame(rows, "row_index long, note string, day string").repartition(7)
    assert clean.infer_column_roles(df).text == ["note", "day"]


def test_columns_below_a_title_are_typed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A title,,\nGia,SoLuong,Code\n1.5,3,1d\n,4,y\n2e3,-5,true\n")
    rows = readers.read_table_files(spark, str(tmp_path), header_row=1)
    assert dict(rows.dtypes) | {"source_file": 0, "row_index": 0} == {
        "Gia": "double", "SoLuong": "int", "Code": "string", "source_file": 0, "row_index": 0,
    }
    assert sorted(r.SoLuong for r in rows.collect()) == [-5, 3, 4]


def test_coverage_counts_resolved_vectors(spark):
    rows = [([1.0, 2.0], None), ([1.0, 2.0], "[3, 4]"), (None, "[1, 2, 3]"), (None, "no json"), ([], "[]"), ([1.0], None), (None, "[5, 6]")]
    got = stats.embedding_coverage({"t": spark.createDataFrame(rows, "embedding array<float>, vector_json string")}, 2).first()
    assert (got.total_rows, got.with_vector, got.with_json, got.without_vector, got.wrong_dimension) == (7, 3, 2, 2, 2)
    assert got.ready and got.warning is None


def test_products(spark):
    df = spark.createDataFrame([("p1", " n ", "1,5", "7"), (None, "x", "2", "3.5"), (" ", "y", "3", "4")], "a string, b string, c string, d string")
    raw = df.toDF(" PRODUCTID", "productname ", "Price", "StockQuantity")
    typed = readers.as_products(raw).collect()
    assert [(r.ProductId, r.Category, r.StockQuantity) for r in typed] == [("p1", None, 7)]
    with pytest.raises(ValueError, match="ProductName"):
        readers.as_products(df.toDF("ProductId", "x", "y", "z"))
    with pytest.raises(ValueError):
        clean.require_fields(df, ["nope"])


def test_requests(spark):
    rows = [
        (1, "hi", None, None, None), (2, " ", 0, 0.0, 1), (3, "x" * 1001, 21, 1.5, 0), (4, None, 20, 1.0, None),
        (5, "x" * 1000, 1, 0.0, 1),
    ]
    asked = spark.createDataFrame(rows, "query_id int, query string, top_k int, threshold double, min_suggestions int")
    good, bad = clean.validate_requests(asked)
    kept = {r.query_id: (r.top_k, r.threshold, r.min_suggestions) for r in good.collect()}
    assert kept == {1: (4, 0.5, 2), 5: (1, 0.0, 1)}
    reasons = {r.query_id: r.reasons for r in bad.collect()}
    assert reasons[2] == ["empty query", "top_k out of range"]
    assert reasons[3] == [
        "query too long", "top_k out of range", "threshold out of range", "min_suggestions out of range",
    ]
    assert reasons[4] == ["empty query"]


def test_content_choice():
    assert clean.content_column(["id", "Name", "Description"]) == "Description"
    assert clean.content_column(["CONTENT", "description"]) == "CONTENT"
    with pytest.raises(ValueError):
        clean.content_column(["id"])


def test_profile(spark):
    df = spark.createDataFrame([(1, "abc", [1.0]), (2, None, None)], "i int, s string, v array<float>")
    got = {r.column_name: r for r in clean.profile_columns(df, approx_distinct=True).collect()}
    assert (got["s"].values_present, got["s"].max_length, got["s"].has_nulls) == (1, 3, True)
    assert got["i"].data_type == "int" and got["i"].approx_distinct == 2 and not got["i"].has_nulls


def test_ids_with_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"), "id")
    got = assign_ids(df.repartition(5), ["g", "id"], "n", start=next_id(None)).collect()
    expected = sorted((r.g, r.id) for r in df.collect())
    assert [(r.g, r.id) for r in sorted(got, key=lambda r: r.n)] == expected
    assert sorted(r.n for r in got) == list(range(1, 5001))
    assert next_id(spark.range(10)) == 10
    assert assign_ids(df.limit(0), ["g", "id"]).count() == 0


def test_presentation(spark):
    ranked = spark.createDataFrame(
        [(1, 1, 10, 0.91234567, "f", 0, "x" * 201), (1, 2, 11, 0.5, "f", 0, "second"), (1, 3, 12, 0.49, None, None, None)],
        "query_id long, rank int, id long, similarity double, file_name string, page_number int, content string",
    )
    filled = present.default_fields(ranked)
    out = present.dedupe_sources(filled).orderBy("rank").collect()
    assert [(r.id, r.file_name, r.page_number) for r in out] == [(10, "f", 1), (12, "unknown", 1)]
    assert out[0].content_preview == "x" * 200 + "..." and out[0].similarity == 0.9123
    context = present.assemble_context(filled).first()
    assert context.context == f"[f, trang 1]: {'x' * 201}\n\n[f, trang 1]: second\n\n[unknown, trang 1]: "
    bands = [r[0] for r in ranked.orderBy("rank").select(present.similarity_band(F.col("similarity"))).collect()]
    assert bands == ["high", "medium", "low"]
    asked = spark.createDataFrame([(1, "why {context}?"), (2, "none")], "query_id long, query string")
    prompts = {r.query_id: r for r in present.render_prompt(present.assemble_context(filled), asked).collect()}
    assert "Câu hỏi: why {context}?" in prompts[1].prompt and not prompts[1].no_results
    assert prompts[2].prompt is None and prompts[2].answer == const.NO_ANSWER_MESSAGE


def test_keyword(spark):
    df = spark.createDataFrame([(3, "xTBKTx"), (1, "a tbkt"), (2, "none"), (4, "50% off"), (5, "500 off")], "id long, content string")
    assert [r.id for r in present.keyword_match(df, "TbKt", 10).collect()] == [1, 3]
    assert [r.id for r in present.keyword_match(df, "50%", 10).collect()] == [4]
    assert [r.id for r in present.keyword_match(df, "o", 1).collect()] == [2]


def chunk_corpus(spark):
    return spark.createDataFrame(
        [(i, [1.0, i / 50], f"text {i}", "f", i, 0) for i in range(30)],
        "id long, embedding array<float>, content string, file_name string, page_number int, chunk_index int",
    )


def test_context_and_suggestion_blocks(spark):
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0], 2, 0.5, True, None), (2, [1.0, 0.0], 2, 0.99999, True, None), (3, [1.0, 0.0], 12, 0.5, True, None),
         (4, [1.0, 0.0], 2, 0.5, False, None), (5, [1.0, 0.0], 2, 0.5, None, [3])],
        "query_id long, query_vec array<float>, top_k int, threshold double, return_suggestions boolean, selected_ids array<long>",
    )
    found = present.retrieve_context(chunk_corpus(spark), asked)
    shape = {
        r.query_id: (r.a, r.b, r.t)
        for r in found.groupBy("query_id").agg(
            F.count_if("in_context").alias("a"), F.count_if("in_suggestions").alias("b"), F.max("total_available").alias("t")
        ).collect()
    }
    assert shape == {1: (2, 10, 30), 2: (1, 0, 1), 3: (12, 10, 30), 4: (2, 0, 30), 5: (2, 0, 30)}
    blocks = present.chat_suggestions(found).collect()
    assert {b.query_id for b in blocks} == {1, 3} and all(len(b.suggestions) == 10 for b in blocks)
    assert blocks[0].message == const.CHAT_SUGGESTION_MESSAGE.replace("{n}", "30")


def test_replies_keep_empty_requests(spark):
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0], 3, 0.5), (2, [1.0, 0.0], 3, 1.5)], "query_id long, query_vec array<float>, top_k int, threshold double"
    )
    replies = {r.query_id: r for r in present.suggestion_replies(present.suggest(chunk_corpus(spark), asked), asked).collect()}
    assert replies[1].total_found == 3 and replies[1].has_multiple and replies[1].message == "Tìm thấy 3 kết quả khớp"
    assert [x["index"] for x in replies[1].suggestions] == [1, 2, 3]
    assert replies[2].total_found == 0 and replies[2].message == const.NOT_FOUND_MESSAGE


def test_answer_paths(spark):
    docs = spark.createDataFrame(
        [(1, "pump power ten"), (2, "valve size two"), (3, "pump size")], "id long, content string"
    )
    corpus = docs.select(
        "id", load.hashed()(F.col("content")).alias("embedding"), "content", F.lit("f").alias("file_name"),
        F.lit(0).alias("page_number"), F.lit(0).alias("chunk_index"),
    )
    asked = spark.createDataFrame(
        [(1, "pump power", 1, 0.1, None, None), (2, "valve", 1, 0.0, None, [3, 2]), (3, " ", 1, 0.1, None, None)],
        "query_id long, query string, top_k int, threshold double, min_suggestions int, selected_ids array<long>",
    )
    got = {r.query_id: r for r in answer_prompts(corpus, asked).collect()}
    assert set(got) == {1, 2, 3}
    assert "pump power ten" in got[1].prompt and got[1].total_sources == 1 and got[2].total_sources == 2
    assert [s.id for s in got[1].sources] == [1] and {s.id for s in got[2].sources} == {2, 3}
    assert got[3].prompt is None and got[3].reasons == ["empty query"] and got[1].reasons == []
    many = {r.query_id: r for r in answer_prompts({"a": corpus, "b": corpus}, asked.drop("selected_ids")).collect()}
    assert set(many) == {1, 2, 3}
    # Chosen ids hold over several corpora too.
    chosen = {r.query_id: r for r in answer_prompts({"a": corpus, "b": corpus}, asked).collect()}
    assert sorted(s.id for s in chosen[2].sources) == [2, 2, 3, 3] and chosen[1].total_sources == 1


def test_stats_on_empty_tables(spark):
    none = chunk_corpus(spark).limit(0)
    got = stats.embedding_coverage({"none": none, "all": chunk_corpus(spark)}, 2).collect()
    by = {r.table_name: r for r in got}
    assert not by["none"].ready and by["none"].warning and by["all"].ready and by["all"].warning is None
    pages = spark.createDataFrame([], "file_name string, page int, text string")
    summary = stats.chunk_load_summary(pages, none).first()
    assert (summary.status, summary.message, summary.total_chunks) == ("warning", const.EMPTY_INPUT_MESSAGE, 0)
    check = stats.verify_load(spark.range(5), spark.range(3), "id").first()
    assert (check.source_rows, check.loaded_rows, check.missing_keys, check.complete) == (5, 3, 2, False)


def write_text(folder, name, body):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(body)


def test_read_files_with_header_row_and_temp_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_text(folder, "a.csv", "title,,\nname,qty,name\nx,1,q\ny,2,r\n")
    write_text(folder, "~$a.csv", "junk,,\nname,qty,name\nz,9,z\n")
    df = readers.read_table_files(spark, folder, header_row=1)
    assert df.columns == ["name", "qty", "name_2", "source_file", "row_index"]
    assert sorted((r.name, r.source_file, r.row_index) for r in df.collect()) == [("x", "a.csv", 0), ("y", "a.csv", 1)]
    assert [r.file for r in readers.list_table_files(spark, folder).collect()] == ["a.csv"]


def test_row_index_across_splits(spark, tmp_path):
    folder = str(tmp_path / "big")
    for name in ("a.csv", "b.csv"):
        write_text(folder, name, "k\n" + "".join(f"{name}{i}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = readers.read_table_files(spark, folder)
        assert df.select("source_file").distinct().count() == 2
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 8000
    assert all(r.k == f"{r.source_file}{r.row_index}" for r in rows)


def test_parquet_row_index(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).coalesce(1).write.parquet(path)
    assert all(r.id == r.row_index for r in readers.read_table_files(spark, path, "parquet").collect())


def test_page_files(spark, tmp_path):
    folder = str(tmp_path / "pages")
    write_text(folder, "doc_0.txt", "first\npage")
    write_text(folder, "doc_1.txt", "second")
    write_text(folder, "note.txt", "single")
    got = {(r.file_name, r.page): r.text for r in readers.read_pages(spark, folder, "text").collect()}
    assert got == {("doc_0.txt", 0): "first\npage", ("doc_1.txt", 1): "second", ("note.txt", 0): "single"}


def test_sheet_stays_aligned_after_dropped_rows(spark):
    rows = [(i, None if i % 3 == 0 else f"row number {i}", None if i % 3 == 0 else float(i), None if i % 3 == 0 else "category words") for i in range(40)]
    df = spark.createDataFrame(rows, "row_index long, who string, amount double, kind string").withColumn("source_file", F.lit("s.csv"))
    loaded = load.table_corpus(df, json_copy=True)
    out = loaded.rows.collect()
    assert len(out) == 26 and sorted(r.id for r in out) == list(range(1, 27))
    assert all(r.combined_text == f"who: row number {r.row_index} | kind: category words" for r in out)
    assert all(len(r.embedding) == 256 and r.vector_json for r in out)
    summary = loaded.summary().first()
    assert (summary.total_rows, summary.rows_imported, summary.text_columns) == (40, 26, ["who", "kind"])


def test_ids_go_on_between_loads(spark, tmp_path):
    pages = spark.createDataFrame([("a.pdf", 0, "one two"), ("b.pdf", 0, "three")], "file_name string, page int, text string")
    where = str(tmp_path / "chunks")
    for _ in range(2):
        summary = load.load_chunks(pages, where).first()
        assert (summary.total_documents, summary.total_chunks, summary.total_files) == (2, 2, 2)
    stored = spark.read.parquet(where)
    assert sorted((r.id, r.chunk_index) for r in stored.collect()) == [(1, 0), (2, 1), (3, 0), (4, 1)]
    cells = spark.createDataFrame([("p2", "Pump", "1.5"), ("p1", "Valve", "x")], "ProductId string, ProductName string, Price string")
    shelf = str(tmp_path / "shelf")
    assert load.load_products(cells, shelf).first().complete
    load.load_products(cells, shelf)
    assert sorted((r.id, r.product_id) for r in spark.read.parquet(shelf).collect()) == [
        (1, "p1"), (2, "p2"), (3, "p1"), (4, "p2"),
    ]


def test_loads_feed_an_index(spark, tmp_path):
    from quillvec.operators import ann, search

    where, index = str(tmp_path / "chunks"), str(tmp_path / "index")
    pages = spark.range(80).select(
        F.concat(F.lit("f"), F.col("id") % 4).alias("file_name"), F.col("id").cast("int").alias("page"),
        F.concat_ws(" ", F.lit("about"), F.expr("transform(sequence(1, 30), i -> concat('w', (id * i) % 97))")).alias("text"),
    )
    load.load_chunks(pages.filter("page < 0"), where, index=index)
    for part in ("page < 50", "page >= 50"):
        load.load_chunks(pages.filter(part), where, index=index, cells=4)
    rows, centroids = ann.open_index(spark, index)
    corpus = spark.read.parquet(where)
    assert sorted(r.id for r in rows.select("id").collect()) == sorted(r.id for r in corpus.select("id").collect()) == list(range(1, 81))
    asked = corpus.filter("id % 20 = 7").select(
        F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"), F.lit(3).alias("top_k"), F.lit(0.0).alias("threshold")
    )
    near = ann.search_ann(rows, asked, centroids, probes=4)
    key = ["query_id", "rank", "id"]
    assert sorted(map(tuple, near.select(*key).collect())) == sorted(map(tuple, search.search_batch(corpus, asked).select(*key).collect()))


def test_training_draws_by_any_share(spark):
    from quillvec.operators import ann

    corpus = spark.range(20000).select("id", F.array(F.cos("id").cast("float"), F.sin("id").cast("float")).alias("embedding"))
    assert ann.train_cells(corpus, 2, rows_per_cell=20).shape == (2, 2)
    share = spark.range(2_000_000).filter(F.xxhash64("id", F.lit(7)) <= F.lit(min(2**63 - 1, int(2e-5 * 2**64) - 2**63))).count()
    assert 10 <= share <= 90


def test_numbering_runs_its_input_once(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(i):
        runs.add(1)
        return f"text {i}"

    df = spark.range(500, numPartitions=4).select("id", counted("id").alias("text"))
    assert sorted((r.n, r.id) for r in assign_ids(df, ["id"], "n").collect()) == [(i + 1, i) for i in range(500)]
    assert runs.value == 500


def test_rows_with_one_key_spread(spark):
    df = spark.range(4000, numPartitions=4).select(F.lit("unknown").alias("g"), "id")
    placed = assign_ids(df, ["g"], "n", partitions=8)
    assert sorted((r.n, r.id) for r in placed.collect()) == [(i + 1, i) for i in range(4000)]


def wide_nodes(frame):
    """The exchanges and sorts of a plan whose rows hold a column named `text`."""
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan()
    found, stack = [], [final.executedPlan() if final.nodeName() == "AdaptiveSparkPlan" else final]
    while stack:
        node = stack.pop()
        if node.nodeName().split(" ")[0] in ("Exchange", "Sort", "BroadcastExchange") and "text#" in node.output().mkString(","):
            found.append(node.nodeName())
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
        if node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
    return found


def test_numbers_reach_rows_without_moving_texts(spark):
    broadcast, buckets = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.shuffle.partitions")
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    try:
        df = spark.range(3000, numPartitions=5).select((F.col("id") * 7 % 3000).alias("id"), F.repeat(F.lit("word "), 40).alias("text"))
        numbered = assign_ids(df, ["id"], "n")
        assert wide_nodes(numbered) == []
        assert sorted((r.n, r.id) for r in numbered.collect()) == [(i + 1, i) for i in range(3000)]
    finally:
        spark.conf.set(broadcast, before)
    assert spark.conf.get("spark.sql.shuffle.partitions") == buckets
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quillvec_rows")]


def test_running_totals_over_slices(spark, monkeypatch):
    from quillvec.operators import ids

    monkeypatch.setattr(ids, "_SLICE_BITS", 4)
    df = spark.range(1000, numPartitions=3).select((F.col("id") * 37 % 1000).alias("id"), (F.col("id") % 5).alias("w"))
    got = ids.running_total(df, ["id"], "t", start=100, size=F.col("w"))
    total = 100
    for r in sorted(got.collect(), key=lambda r: r.id):
        assert r.t == total
        total += r.w
    assert total == 100 + 2000


def test_pages_are_cut_once(spark):
    from quillvec.operators.chunks import chunk_metadata

    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(i):
        runs.add(1)
        return f"page {i}. " + "words " * int(i * 13 % 200)

    pages = spark.range(60, numPartitions=4).select(
        F.concat(F.lit("f"), F.col("id") % 7).alias("file_name"), F.col("id").cast("int").alias("page"), counted(F.col("id").cast("int")).alias("text")
    )
    rows = sorted(chunk_metadata(pages, "fixed").collect(), key=lambda r: r.chunk_index)
    assert runs.value == 60
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert [(r.file_name, r.page_number, r.pos) for r in rows] == sorted((r.file_name, r.page_number, r.pos) for r in rows)


def test_records_with_line_breaks_in_split_files(spark, tmp_path):
    """Quoted cells with line breaks, blank lines, delimiters and quotes, in files cut every 300 bytes."""
    import csv
    import io
    import random

    draw, expected = random.Random(1), {}
    for f in range(4):
        rows = [["a", "b", "c"]]
        for i in range(40):
            cell = draw.choice(["x", "a\nb", 'q"uo"te', "c,d", "", "\n\n", 'line one\n\nline "three"\n', " sp "])
            rows.append([f"{cell}{i}", draw.choice(["p", "\n"]), str(i)])
        text = io.StringIO()
        csv.writer(text, lineterminator=["\n", "\r\n"][f % 2]).writerows(rows)
        body = text.getvalue() + ('tail,5" pipe x,7\n\n\nlast,1,2' if f == 2 else "")
        write_text(str(tmp_path / "in"), f"t{f}.csv", body)
        expected[f"t{f}.csv"] = [r for r in csv.reader(io.StringIO(body, newline="")) if r]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        cells = F.from_csv("line", "a string, b string, c string", {"escape": '"'})
        found = readers.read_records(spark, str(tmp_path / "in")).withColumn("cells", cells).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, rows in expected.items():
        mine = sorted((r for r in found if r.source_file.endswith(name)), key=lambda r: r.row_index)
        assert [r.row_index for r in mine] == list(range(len(rows)))
        assert [[c or "" for c in r.cells] for r in mine] == [[c.replace("\r\n", "\n") for c in r] for r in rows]


def test_folder_load_keeps_cells_with_line_breaks(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    body = "who,what,amount\n" + "".join(f'"person ""{i}""\n\nof two, or more",thing number {i},{i}\n' for i in range(50))
    write_text(folder, "broken.csv", body)
    row = load.load_table_files(spark, folder, target).first()
    assert (row.status, row.error, row.rows_imported) == ("success", None, 50)
    stored = spark.read.parquet(row.location)
    assert {r.who for r in stored.collect()} == {f'person "{i}"\n\nof two, or more' for i in range(50)}


def test_folder_load_reports_failures(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    body = "who,what,amount\n" + "".join(f"person number {i},thing {i},{i}\n" for i in range(20))
    write_text(folder, "good one-a.csv", body)
    write_text(folder, "void.csv", "who,what\n")
    results = load.load_table_files(spark, folder, target, prefix="t")
    by = {r.file: r for r in results.collect()}
    assert by["good one-a.csv"].status == "success" and by["good one-a.csv"].rows_imported == 20
    assert by["void.csv"].status == "warning" and by["void.csv"].rows_imported == 0
    table = spark.read.parquet(f"{by['good one-a.csv'].location}/table_name=t_good_one_a")
    assert sorted(r.id for r in table.collect()) == list(range(1, 21)) and dict(table.dtypes)["amount"] == "double"
    # The folder loaded again goes on with the ids of each table.
    load.load_table_files(spark, folder, target, prefix="t").collect()
    again = spark.read.parquet(f"{by['good one-a.csv'].location}/table_name=t_good_one_a")
    assert sorted(r.id for r in again.collect()) == list(range(1, 41))
    total = stats.batch_load_summary(results).first()
    assert (total.files_processed, total.files_success) == (2, 1)


def test_append_and_evolve(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], "id long, x string")
    two = spark.createDataFrame([(2, 5.0), (2, 5.0)], "id long, y double")
    sinks.append_corpus(one, path)
    sinks.append_corpus(sinks.align_to(two, spark.read.parquet(path)), path, dedupe_key=["id"])
    sinks.append_corpus(one, path, dedupe_key=["id"])
    rows = sorted((r.id, r.x, r.y) for r in readers.load_corpus(spark, path).collect())
    assert rows == [(1, "a", None), (2, None, 5.0)]
    sinks.append_corpus(one, path)
    assert readers.load_corpus(spark, path).count() == 3
    sinks.append_corpus(one, path, "overwrite")
    assert readers.load_corpus(spark, path).count() == 1
    assert sinks.missing_columns(["a", "b"], ["b"]) == ["a"]
    with pytest.raises(ValueError):
        sinks.append_corpus(one, path, "ignore")


def test_columns_are_noted_beside_the_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    for i, frame in enumerate(("id long, x string", "id long, x string", "id long, y double", "id long, X string, z int")):
        width = frame.count(",") + 1
        sinks.append_corpus(spark.createDataFrame([tuple([i] + [None] * (width - 1))], frame), path)
    assert spark.read.text(f"{path}/{sinks.NOTES}").count() == 3
    assert sinks.noted_schema(spark, path).names == ["id", "x", "y", "z"]
    opened = readers.load_corpus(spark, path)
    assert opened.columns == ["id", "x", "y", "z"] and sorted(r.id for r in opened.collect()) == [0, 1, 2, 3]
    assert sinks.stored(spark, path).columns == opened.columns
    # A folder that others wrote is read by its footers, and noted by the next load.
    other = str(tmp_path / "o")
    assert sinks.noted_schema(spark, other) is None and sinks.stored(spark, other) is None
    spark.range(3).write.parquet(other)
    sinks.append_corpus(spark.range(2).withColumn("w", F.lit(1)), other)
    assert sinks.noted_schema(spark, other).names == ["id", "w"] and readers.load_corpus(spark, other).count() == 5
    sinks.append_corpus(spark.range(2), other, "overwrite")
    assert readers.load_corpus(spark, other).columns == ["id"]


def test_saved_table(spark):
    import uuid

    name = f"t_{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, x string")
    sinks.append_corpus(rows, name, table=True, dedupe_key=["id"])
    sinks.append_corpus(rows, name, table=True, dedupe_key=["id"])
    assert readers.load_corpus(spark, name, table=True).count() == 2
    sinks.append_corpus(rows, name, "overwrite", table=True)
    assert readers.load_corpus(spark, name, table=True).count() == 3
    spark.sql(f"DROP TABLE {name}")


def test_stream_equals_batch_and_takes_new_files_only(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    pages = spark.createDataFrame(
        [(f"d/{i % 3}.pdf", i, f"page {i}. " + "words " * (i * 7)) for i in range(20)], "source string, page int, text string"
    )

    def run():
        ingest_incremental(spark, inbox, out, state, pages.schema).awaitTermination()

    pages.filter("page < 10").write.parquet(inbox)
    run()
    first = spark.read.parquet(out).count()
    run()
    assert spark.read.parquet(out).count() == first
    pages.filter("page >= 10").write.mode("append").parquet(inbox)
    run()
    batch = corpus_of_pages(readers.as_pages(pages, "source", "page", "text"))
    key = ["id", "file_name", "page_number", "chunk_index", "content"]
    assert sorted(map(tuple, spark.read.parquet(out).select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))


def test_scratch_is_never_machine_local_on_a_cluster(spark):
    from quillvec.session import scratch_path

    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_rows_of_a_table_are_not_brought_to_one_task(spark, tmp_path, monkeypatch):
    """Files of one header: neither read nor numbered lines are dealt by file or table, nor sorted to be written by table."""
    folder, broadcast = tmp_path / "inbox", "spark.sql.autoBroadcastJoinThreshold"
    folder.mkdir()
    for name in ("a", "b"):
        lines = "".join(f"some words {i},thing {i},{i}\n" for i in range(5))
        (folder / f"{name}.csv").write_text("note,what,number\n" + lines)
    seen, append = [], load.append_corpus

    def noted(df, *args, **options):
        seen.append((df._jdf.queryExecution().executedPlan().toString(), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        append(df, *args, **options)

    monkeypatch.setattr(load, "append_corpus", noted)
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    try:
        results = load.load_table_files(spark, str(folder), str(tmp_path / "tables"))
        assert sorted((r.file, r.status, r.rows_imported) for r in results.collect()) == [("a.csv", "success", 5), ("b.csv", "success", 5)]
        location = results.select("location").first()[0]
    finally:
        spark.conf.set(broadcast, before)
    (plan, files), = seen
    assert "SortMergeJoin" not in plan and files == "64"
    stored = spark.read.parquet(location)
    assert sorted((r.table_name, r.id) for r in stored.select("table_name", "id").collect()) == [(t, i + 1) for t in ("a", "b") for i in range(5)]


def test_slices_of_one_task_spread_over_buckets(spark):
    """Rows that one task wrote are numbered in as many tasks as there are buckets, each with its share."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(0, 400_000, 1, 1)
    held = [r["count"] for r in ids._in_slices(rows).groupBy(F.input_file_name().alias("bucket")).count().collect()]
    assert len(held) == buckets and max(held) < 2 * 400_000 / buckets


def test_vectors_are_written_without_a_group_per_value(spark, tmp_path):
    """Vectors lie in two-level lists; a folder that holds older files in three levels reads as one table."""
    target = str(tmp_path / "t")
    cells = [(i, f"f{i}", f"some words of row {i}", "another cell", float(i)) for i in range(20)]
    rows = spark.createDataFrame(cells, "row_index long, source_file string, note string, kind string, amount double")
    load.load_table(rows, target)
    leaves = {pq.ParquetFile(f).schema.column(i).path for f in glob.glob(f"{target}/*.parquet") for i in range(len(pq.ParquetFile(f).schema))}
    assert "embedding.array" in leaves and not [x for x in leaves if x.startswith("embedding.list")]
    assert spark.conf.get("spark.sql.parquet.writeLegacyFormat") == "false"
    first = spark.read.schema(sinks.noted_schema(spark, target)).parquet(target)
    first.withColumn("id", F.col("id") + 20).write.mode("append").parquet(target)
    both = {(r["id"] - 1) % 20: set() for r in first.collect()}
    for r in spark.read.schema(sinks.noted_schema(spark, target)).parquet(target).collect():
        both[(r["id"] - 1) % 20].add((r["note"], tuple(r["embedding"])))
    assert len(both) == 20 and all(len(found) == 1 for found in both.values())
