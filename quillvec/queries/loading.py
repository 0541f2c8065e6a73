from __future__ import annotations

from pyspark.sql import functions as F

from quillvec.functions.vector import vector_from_json
from quillvec.operators import ann, stats
from quillvec.operators.ids import assign_ids, next_id
from quillvec.plans import load
from quillvec.queries import inputs
from quillvec.queries.cleaning import TYPED_SELECT, _contract_names, _shown
from quillvec.queries.inputs import FIXED, PAGES, SHEET, TYPED_PRODUCTS, hash_counts
from quillvec.queries.registry import query
from quillvec.session import OPEN_FILES, held_setting, scratch_path
from quillvec.sources import readers, sinks
from quillvec.streaming.ingest import corpus_of_pages, ingest_incremental


def _customers(spark, sf):
    return inputs.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )


def _suppliers(spark, sf):
    return inputs.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )


EVOLVED = """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier"""


@query("evolve_schema", EVOLVED)
def evolve_schema(spark, sf):
    return sinks.evolve_schema(_customers(spark, sf), _suppliers(spark, sf))


@query("append_corpus", EVOLVED)
def append_corpus(spark, sf):
    """Two loads with different columns into one folder, read back as one table."""
    target = scratch_path(spark, "append")
    sinks.append_corpus(_customers(spark, sf), target, "overwrite")
    stored = spark.read.parquet(target)
    sinks.append_corpus(sinks.align_to(_suppliers(spark, sf), stored), target)
    return readers.load_corpus(spark, target).select("key", "name", "segment", "balance")


@query("append_deduplicated", """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer""")
def append_deduplicated(spark, sf):
    """The same load twice, kept once by its key."""
    target = scratch_path(spark, "dedupe")
    sinks.append_corpus(_customers(spark, sf), target, "overwrite", dedupe_key=["key"])
    sinks.append_corpus(_customers(spark, sf), target, dedupe_key=["key"])
    return readers.load_corpus(spark, target)


@query("assign_ids", """WITH before AS (SELECT max(s_suppkey) AS m FROM supplier)
SELECT o_orderkey, o_orderpriority,
       (SELECT m FROM before) + row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS id FROM orders""")
def ids(spark, sf):
    """Numbers that go on from the largest one already given."""
    start = next_id(inputs.table(spark, sf, "supplier"), "s_suppkey")
    rows = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return assign_ids(rows, ["o_orderpriority", "o_orderkey"], "id", start)


@query("stamp_load", """SELECT event_id, 'events.parquet' AS source_file, event_id AS row_index, TRUE AS stamped FROM events""")
def stamp_load(spark, sf):
    rows = inputs.table(spark, sf, "events").select("event_id")
    stamped = sinks.stamp_load(rows, "events.parquet", "event_id")
    fresh = F.col("created_at").isNotNull() & (F.col("created_at") == F.col("updated_at"))
    return stamped.select("event_id", "source_file", "row_index", fresh.alias("stamped"))


@query("read_pages", f"WITH {PAGES} SELECT 'data/' || file_name AS source, file_name, page_number AS page, text FROM pages_in")
def read_pages(spark, sf):
    rows = inputs.pages(spark, sf)
    return readers.as_pages(rows, "source", "page", "text")


@query("read_products", f"WITH {TYPED_PRODUCTS} {TYPED_SELECT} FROM kept")
def read_products(spark, sf):
    """The catalogue written as CSV text and read back as typed products."""
    target = scratch_path(spark, "products")
    cells = inputs.product_cells(spark, sf)
    cells.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(target)
    return _shown(_contract_names(readers.read_products(spark, target)))


@query("load_corpus", """SELECT vec_id AS id, label, len(embedding)::INTEGER AS dim FROM embeddings""")
def load_corpus(spark, sf):
    target = scratch_path(spark, "corpus")
    sinks.append_corpus(inputs.corpus(spark, sf), target, "overwrite", partition_by=["label"])
    rows = readers.load_corpus(spark, target)
    return rows.select("id", "label", F.size("embedding").alias("dim"))


@query("read_table_files", """SELECT c_custkey, c_name, c_acctbal FROM customer""")
def read_table_files(spark, sf):
    """Customers as CSV files, read back with their file and row numbers."""
    target = scratch_path(spark, "sheets")
    rows = inputs.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    rows.repartition(3, "c_custkey").write.option("header", True).csv(target)
    read = readers.read_table_files(spark, target)
    return read.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal")


@query("read_table_header_row", """SELECT c_custkey AS "Key", c_name AS "Name", c_acctbal AS "Balance", TRUE AS typed FROM customer""")
def read_table_header_row(spark, sf):
    """A sheet with a title line above its header: numbers stay numbers."""
    target = scratch_path(spark, "titled")
    rows = inputs.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("a"), F.col("c_name").alias("b"), F.col("c_acctbal").cast("string").alias("c")
    )
    above = spark.createDataFrame([(0, "Customers of the year", None, None), (1, "Key", "Name", "Balance")], "n int, a string, b string, c string")
    titled = above.unionByName(rows.withColumn("n", F.lit(2))).coalesce(1).sortWithinPartitions("n").drop("n")
    titled.write.csv(target)
    read = readers.read_table_files(spark, target, header_row=1)
    numbers = dict(read.dtypes)["Key"] in ("int", "bigint") and dict(read.dtypes)["Balance"] == "double"
    return read.select(F.col("Key").cast("long").alias("Key"), "Name", "Balance", F.lit(numbers).alias("typed"))


@query("row_numbers", """SELECT TRUE AS one_number_per_row, count(*) AS total_rows FROM customer""")
def row_numbers(spark, sf):
    """Row numbers of each file run from 0 without gaps."""
    target = scratch_path(spark, "sheets")
    rows = inputs.table(spark, sf, "customer").select("c_custkey", "c_name")
    rows.repartition(3, "c_custkey").write.option("header", True).csv(target)
    per_file = readers.read_table_files(spark, target).groupBy("source_file").agg(
        F.count("*").alias("n"), F.countDistinct("row_index").alias("d"), F.max("row_index").alias("last")
    )
    good = (F.col("n") == F.col("d")) & (F.col("last") == F.col("n") - 1)
    return per_file.agg(F.bool_and(good).alias("one_number_per_row"), F.sum("n").alias("total_rows"))


CORPUS_SQL = f"""WITH {FIXED}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY file_name, page_number, pos) AS id FROM fixed),
{hash_counts("content", "id", "numbered")}
SELECT n.id, n.file_name, n.page_number, n.id - 1 AS chunk_index, n.content, count(*) AS buckets, 256 AS dim,
       256 AS json_dim
FROM numbered n JOIN weights w USING (id) GROUP BY ALL"""


@query("load_chunks", CORPUS_SQL)
def load_chunks(spark, sf):
    """Pages to a stored corpus of numbered, encoded chunks."""
    target = scratch_path(spark, "chunks")
    load.load_chunks(inputs.pages(spark, sf), target, method="fixed", json_copy=True)
    rows = readers.load_corpus(spark, target)
    buckets = F.size(F.filter("embedding", lambda x: x != 0)).cast("long")
    return rows.select(
        "id", "file_name", "page_number", "chunk_index", "content", buckets.alias("buckets"),
        F.size("embedding").alias("dim"), F.size(vector_from_json(F.col("vector_json"))).alias("json_dim"),
    )


# Roles of the sheet: text who, kind, note; numeric amount; datetime happened; code is too short to count.
TABLE_SQL = f"""WITH {SHEET}, dense AS (
  SELECT *, row_number() OVER (ORDER BY row_index) AS id, concat_ws(' | ', 'who: ' || who, 'kind: ' || kind, 'note: ' || note) AS combined
  FROM filled_cells WHERE n_cells >= 3),
{hash_counts("combined", "row_index", "dense")}
SELECT any_value(d.id) AS id, d.row_index, 'events.csv' AS source_file, who, kind, note, amount, happened, combined AS combined_text,
       count(*) AS buckets FROM dense d JOIN weights w USING (row_index) GROUP BY ALL"""


@query("load_table", TABLE_SQL)
def load_table(spark, sf):
    """An untidy sheet to stored rows: cleaned, typed by role, combined, encoded, written and read back."""
    target = scratch_path(spark, "table")
    load.load_table(inputs.sheet(spark, sf), target)
    rows = readers.load_corpus(spark, target)
    return rows.select(
        "id", "row_index", "source_file", "who", "kind", "note", "amount",
        F.date_format("happened", "yyyy-MM-dd HH:mm:ss").alias("happened"), "combined_text",
        F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("buckets"),
    )


@query("load_table_twice", """WITH rows AS (
  SELECT event_id AS row_index, 'first' AS source_file, 'user number ' || user_id AS who, event_type AS kind, value AS amount, NULL AS place, NULL AS unfit FROM events
  UNION ALL SELECT event_id, 'second', 'user number ' || user_id, event_type, CASE WHEN event_id % 2 = 0 THEN value END,
    'some place ' || (event_id % 9), CASE WHEN event_id % 2 = 1 THEN 'about ' || event_id || ' pieces' END FROM events)
SELECT row_number() OVER (ORDER BY source_file, row_index) AS id, * FROM rows""")
def load_table_twice(spark, sf):
    """Two loads of one table; the second brings a new column, and text among the numbers."""
    target = scratch_path(spark, "drift")
    key = F.col("event_id")
    rows = inputs.table(spark, sf, "events").select(
        key.alias("row_index"), F.concat(F.lit("user number "), F.col("user_id").cast("string")).alias("who"),
        F.col("event_type").alias("kind"), F.col("value").alias("amount"),
    )
    load.load_table(rows.withColumn("source_file", F.lit("first")), target)
    drift = rows.withColumns(
        {
            "amount": F.when(F.col("row_index") % 2 == 0, F.col("amount").cast("string")).otherwise(
                F.concat(F.lit("about "), F.col("row_index").cast("string"), F.lit(" pieces"))
            ),
            "place": F.concat(F.lit("some place "), (F.col("row_index") % 9).cast("string")),
            "source_file": F.lit("second"),
        }
    )
    load.load_table(drift, target)
    stored = readers.load_corpus(spark, target)
    return stored.select("id", "row_index", "source_file", "who", "kind", "amount", "place", F.col("unfit_cells")["amount"].alias("unfit"))


@query("table_load_summary", f"""WITH {SHEET}
SELECT count(*) AS total_rows, count(*) FILTER (n_cells >= 3) AS rows_imported, 'success' AS status,
       NULL::VARCHAR AS message, 'who,kind,note' AS text_columns, 'amount' AS numeric_columns,
       'happened' AS datetime_columns, 'code' AS ignored_columns, TRUE AS has_embeddings FROM filled_cells""")
def table_load_summary(spark, sf):
    summary = load.table_corpus(inputs.sheet(spark, sf)).summary()
    lists = ["text_columns", "numeric_columns", "datetime_columns", "ignored_columns"]
    return summary.withColumns({c: F.array_join(c, ",") for c in lists})


@query("load_products", f"""WITH {TYPED_PRODUCTS}, described AS (
  SELECT *, row_number() OVER (ORDER BY product_id) AS id, concat_ws('. ', 'Product: ' || product_name, 'Category: ' || category, 'Description: ' || description,
            'Price: $' || printf('%,.2f', price::DOUBLE)) || '.' AS context FROM kept),
{hash_counts("context", "product_id", "described")}
SELECT any_value(d.id) AS id, d.product_id, d.product_name, d.category, d.price::DOUBLE AS price, d.stock_quantity::INTEGER AS stock_quantity,
       d.last_updated, d.context AS full_text_context, count(*) AS buckets
FROM described d JOIN weights w USING (product_id) GROUP BY ALL""")
def load_products(spark, sf):
    rows = load.product_corpus(inputs.product_cells(spark, sf))
    return _shown(rows).select(
        "id", "product_id", "product_name", "category", "price", "stock_quantity", "last_updated", "full_text_context",
        F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("buckets"),
    )


@query("load_products_check", f"""WITH {TYPED_PRODUCTS}
SELECT count(*) AS source_rows, count(*) AS loaded_rows, 0::BIGINT AS missing_keys, TRUE AS complete FROM kept""")
def load_products_check(spark, sf):
    return load.load_products(inputs.product_cells(spark, sf), scratch_path(spark, "catalogue"))


@query("load_products_twice", f"""WITH {TYPED_PRODUCTS}
SELECT count(*) AS source_rows, count(*) AS loaded_rows, 0::BIGINT AS missing_keys, TRUE AS complete, 2 * count(*) AS stored_rows,
       2 * count(*) AS last_id FROM kept""")
def load_products_twice(spark, sf):
    """The same catalogue loaded again: the check looks at the rows of its own load."""
    target = scratch_path(spark, "catalogue")
    load.load_products(inputs.product_cells(spark, sf), target)
    check = load.load_products(inputs.product_cells(spark, sf), target)
    total = spark.read.parquet(target).agg(F.count("*").alias("stored_rows"), F.max("id").alias("last_id"))
    return check.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query("batch_load_summary", """SELECT count(DISTINCT event_type) + 1 AS files_processed,
  count(DISTINCT event_type) AS files_success, 1::BIGINT AS files_empty, 0::BIGINT AS files_failed,
  count(*)::BIGINT AS rows_imported, 'completed' AS status FROM events""")
def batch_load_summary(spark, sf):
    """One result row per event type as a file, and one file that held nothing."""
    per_file = inputs.table(spark, sf, "events").groupBy(F.col("event_type").alias("file")).agg(
        F.count("*").alias("rows_imported")
    )
    good = per_file.select("file", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"), "rows_imported")
    empty = spark.createDataFrame([("nothing", "warning", "empty input", 0)], good.schema)
    return stats.batch_load_summary(good.unionByName(empty))


@query("load_table_files", """SELECT event_type, 0::BIGINT AS failed, count(*) AS rows_imported FROM events GROUP BY event_type""")
def load_table_files(spark, sf):
    """Events written as CSV files by type, each loaded with a result of its own."""
    folder, target = scratch_path(spark, "inbox"), scratch_path(spark, "tables")
    rows = inputs.table(spark, sf, "events").select(
        F.concat(F.lit("user number "), F.col("user_id").cast("string")).alias("who"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("happened"),
        "value",
        "event_type",
    )
    with held_setting(spark, OPEN_FILES, "64"):
        rows.write.partitionBy("event_type").option("header", True).csv(folder)
    results = load.load_table_files(spark, folder, target)
    return results.groupBy(F.regexp_extract("source_file", "event_type=([^/]+)", 1).alias("event_type")).agg(
        F.count_if(F.col("status") != "success").alias("failed"), F.sum("rows_imported").alias("rows_imported")
    )


@query("load_chunks_indexed", f"""WITH {FIXED}
SELECT file_name, page_number, content FROM fixed WHERE regexp_matches(content, '\\S')""")
def load_chunks_indexed(spark, sf):
    """Pages in two loads, the second into the index that the first has built; every chunk is in a cell of it."""
    target, index = scratch_path(spark, "chunks"), scratch_path(spark, "index")
    pages = inputs.pages(spark, sf)
    for half in (0, 1):
        load.load_chunks(pages.filter(F.col("page") % 2 == half), target, method="fixed", index=index, cells=8)
    rows, _ = ann.open_index(spark, index)
    return rows.filter("cell is not null").select("file_name", "page_number", "content")


@query("load_broken_lines", """SELECT event_type, 0::BIGINT AS failed, count(*) AS rows_imported, count(*) AS whole_cells,
  sum(event_id)::BIGINT AS numbers FROM events GROUP BY event_type""")
def load_broken_lines(spark, sf):
    """Events as CSV files whose quoted cells hold line breaks, blank lines, delimiters and quotes, read in splits."""
    folder, target = scratch_path(spark, "inbox"), scratch_path(spark, "tables")
    note = F.concat(F.lit('said "'), "props", F.lit('",\n\nthen user\n'), F.col("user_id").cast("string"))
    rows = inputs.table(spark, sf, "events").select(note.alias("note"), F.col("event_id").alias("number"), "value", "event_type")
    with held_setting(spark, OPEN_FILES, "64"):
        rows.write.partitionBy("event_type").option("header", True).option("escape", '"').csv(folder)
    with held_setting(spark, "spark.sql.files.maxPartitionBytes", "131072"):
        results = load.load_table_files(spark, folder, target)
        kind = F.regexp_extract("source_file", "event_type=([^/]+)", 1).alias("event_type")
        counts = results.groupBy(kind).agg(F.count_if(F.col("status") != "success").alias("failed"), F.sum("rows_imported").alias("rows_imported"))
        location = results.select("location").first()[0]
    stored = spark.read.parquet(location).groupBy(kind).agg(
        F.count_if(F.col("note").rlike('^said "(?s:.*)",\n\nthen user\n\\d+$')).alias("whole_cells"), F.sum("number").cast("long").alias("numbers")
    )
    return counts.join(stored, "event_type")


@query("ingest_incremental", f"""WITH {FIXED}
SELECT file_name, page_number, pos AS chunk_index, content FROM fixed WHERE regexp_matches(content, '\\S')""")
def incremental(spark, sf):
    """Documents arrive in two folders' worth of files; each run takes the new ones only."""
    inbox, target, state = (scratch_path(spark, label) for label in ("inbox", "stream", "state"))
    rows = inputs.pages(spark, sf).select("source", "page", "text")
    arrivals = rows.withColumn("half", F.col("page") % 2)
    for half in (0, 1):
        arrivals.filter(F.col("half") == half).drop("half").write.mode("append").parquet(inbox)
        run = ingest_incremental(
            spark, inbox, target, state, rows.schema, method="fixed", partitions=spark.sparkContext.defaultParallelism
        )
        run.awaitTermination()
    return spark.read.parquet(target).select("file_name", "page_number", "chunk_index", "content")


@query("ingest_again", f"""WITH {FIXED}
SELECT file_name, page_number, pos AS chunk_index, content FROM fixed WHERE regexp_matches(content, '\\S')""")
def ingest_again(spark, sf):
    """All pages arrive, and half of them once more in a later file."""
    inbox, target, state = (scratch_path(spark, label) for label in ("inbox", "stream", "state"))
    rows = inputs.pages(spark, sf).select("source", "page", "text")
    for arrival in (rows, rows.filter(F.col("page") % 2 == 0)):
        arrival.write.mode("append").parquet(inbox)
        ingest_incremental(spark, inbox, target, state, rows.schema, method="fixed").awaitTermination()
    return spark.read.parquet(target).select("file_name", "page_number", "chunk_index", "content")


@query("ingest_batch", f"""WITH {FIXED}
SELECT file_name, page_number, pos AS chunk_index, content FROM fixed WHERE regexp_matches(content, '\\S')""")
def ingest_batch(spark, sf):
    corpus = corpus_of_pages(inputs.pages(spark, sf), method="fixed")
    return corpus.select("file_name", "page_number", "chunk_index", "content")
