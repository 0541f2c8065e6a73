"""The operator inputs built from the given tables, each with its SQL form.

Where an operator needs nulls, blanks or odd sizes, they are derived from the row key; no row is left out.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- vectors and requests ------------------------------------------------------------------------


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks, with a top_k of 3 to 7 and a threshold of 0.2 to 0.3."""
    third = F.col("label") % 3
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("query_vec"),
        (F.lit(3) + F.col("label") % 5).cast("int").alias("top_k"),
        F.when(third == 0, 0.2).when(third == 1, 0.25).otherwise(0.3).alias("threshold"),
        "label",
    )


REQ = """req AS (
  SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, (3 + label % 5) AS top_k, label AS qlabel,
         CASE label % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.25 ELSE 0.3 END::DOUBLE AS threshold
  FROM embeddings)"""
PAIRS = REQ + """, pairs AS (
  SELECT r.query_id, r.top_k, r.threshold, r.qlabel, e.vec_id AS id, e.label,
         list_cosine_similarity(r.qv, e.embedding::DOUBLE[]) AS sim
  FROM req r CROSS JOIN embeddings e)"""
HITS = PAIRS + """, hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank,
         count(*) OVER (PARTITION BY query_id) AS total
  FROM pairs WHERE sim >= threshold)"""


def mean_vector(spark: SparkSession, sf: str) -> list[float]:
    """The mean of all vectors: one value per dimension."""
    vectors = table(spark, sf, "embeddings").select(array_to_vector(F.col("embedding")).alias("v"))
    mean = vectors.select(Summarizer.mean(F.col("v")).alias("mean")).first()["mean"]
    return [float(x) for x in mean.toArray().astype("float32")]


MEAN = """mean AS (
  SELECT list(m ORDER BY pos)::DOUBLE[] AS qv FROM (
    SELECT pos, avg(x::DOUBLE)::FLOAT AS m
    FROM (SELECT generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings)
    GROUP BY pos))"""


# --- chunk corpus --------------------------------------------------------------------------------


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with document text; some files, pages and texts are missing."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 13 != 5, F.col("text")).alias("content"),
        F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("file_name"),
        F.when(F.col("doc_id") % 17 != 0, F.col("doc_id") % 7).cast("int").alias("page_number"),
        (F.col("doc_id") % 5).cast("int").alias("chunk_index"),
    )
    return corpus(spark, sf).join(docs, "id", "left")


CHUNKS = """chunks AS (
  SELECT e.vec_id AS id, e.embedding, e.label,
         CASE WHEN doc_id % 13 <> 5 THEN text END AS content,
         CASE WHEN doc_id % 11 <> 0 THEN source END AS file_name,
         CASE WHEN doc_id % 17 <> 0 THEN doc_id % 7 END::INTEGER AS page_number,
         (doc_id % 5)::INTEGER AS chunk_index
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)"""
FILLED = CHUNKS + """, filled AS (
  SELECT id, coalesce(content, '') AS content, coalesce(file_name, 'unknown') AS file_name,
         coalesce(page_number, 0) AS page_number, coalesce(chunk_index, 0) AS chunk_index FROM chunks)"""


# --- catalogue -----------------------------------------------------------------------------------


def products(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a catalogue, joined to their vectors; most parts have none."""
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("description"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        F.col("p_size").alias("stock_quantity"),
    )
    return parts.join(corpus(spark, sf).drop("label"), "id", "left")


PRODUCTS = """products AS (
  SELECT p_partkey AS id, 'P' || p_partkey AS product_id, p_name AS product_name, p_type AS category,
         p_brand AS description, p_retailprice::DECIMAL(18,2) AS price, p_size AS stock_quantity,
         e.embedding
  FROM part LEFT JOIN embeddings e ON p_partkey = e.vec_id)"""


# --- sheets --------------------------------------------------------------------------------------


def sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an untidy sheet: null cells, null rows, a dead column, dates as text, short codes."""
    key = F.col("event_id")
    alive = key % 10 != 3
    return table(spark, sf, "events").select(
        key.alias("row_index"),
        F.when(alive & (key % 4 != 1), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("happened"),
        F.when(alive, F.concat(F.lit("user number "), F.col("user_id").cast("string"))).alias("who"),
        F.when(alive & (key % 3 != 0), F.col("event_type")).alias("kind"),
        F.when(alive & (key % 5 != 2), F.col("value")).alias("amount"),
        F.when(alive & (key % 7 != 6), F.substring("event_type", 1, 2)).alias("code"),
        F.lit(None).cast("string").alias("dead"),
        F.when(alive & (key % 2 == 0), F.col("props")).alias("note"),
        F.lit("events.csv").alias("source_file"),
    )


SHEET_CELLS = ["happened", "who", "kind", "amount", "code", "dead", "note"]
SHEET = """sheet AS (
  SELECT event_id AS row_index,
         CASE WHEN event_id % 10 <> 3 AND event_id % 4 <> 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS happened,
         CASE WHEN event_id % 10 <> 3 THEN 'user number ' || user_id END AS who,
         CASE WHEN event_id % 10 <> 3 AND event_id % 3 <> 0 THEN event_type END AS kind,
         CASE WHEN event_id % 10 <> 3 AND event_id % 5 <> 2 THEN value END AS amount,
         CASE WHEN event_id % 10 <> 3 AND event_id % 7 <> 6 THEN substring(event_type, 1, 2) END AS code,
         NULL::VARCHAR AS dead,
         CASE WHEN event_id % 10 <> 3 AND event_id % 2 = 0 THEN props END AS note
  FROM events),
filled_cells AS (
  SELECT *, (happened IS NOT NULL)::INT + (who IS NOT NULL)::INT + (kind IS NOT NULL)::INT
          + (amount IS NOT NULL)::INT + (code IS NOT NULL)::INT + (note IS NOT NULL)::INT AS n_cells
  FROM sheet)"""


def product_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as untyped catalogue cells with odd headers, blanks and unreadable numbers."""
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.when(key % 19 != 7, F.concat(F.lit("P"), key.cast("string"))).alias(" productid "),
        F.when(key % 23 == 4, F.lit("  ")).otherwise(F.col("p_name")).alias("PRODUCTNAME"),
        F.when(key % 6 != 5, F.col("p_type")).alias("Category"),
        F.col("p_brand").alias("description"),
        F.when(key % 8 == 1, F.lit("n/a")).otherwise(F.format_number(F.col("p_retailprice"), 2)).alias("Price"),
        F.when(key % 9 == 2, F.lit("3.5")).otherwise(F.col("p_size").cast("string")).alias("StockQuantity"),
        F.when(key % 5 == 0, F.lit("not a date")).otherwise(F.lit("2024-03-0")).alias("_day"),
        key.alias("_key"),
    ).withColumn(
        "LastUpdated",
        F.when(F.col("_day") == "not a date", F.col("_day")).otherwise(
            F.concat(F.col("_day"), (F.col("_key") % 9 + 1).cast("string"))
        ),
    ).drop("_day", "_key")


TYPED_PRODUCTS = """typed AS (
  SELECT CASE WHEN p_partkey % 19 <> 7 THEN 'P' || p_partkey END AS product_id,
         CASE WHEN p_partkey % 23 = 4 THEN '  ' ELSE p_name END AS product_name,
         CASE WHEN p_partkey % 6 <> 5 THEN p_type END AS category,
         p_brand AS description,
         CASE WHEN p_partkey % 8 <> 1 THEN p_retailprice::DECIMAL(18,2) END AS price,
         CASE WHEN p_partkey % 9 <> 2 THEN p_size END AS stock_quantity,
         CASE WHEN p_partkey % 5 <> 0 THEN '2024-03-0' || (p_partkey % 9 + 1) || ' 00:00:00' END AS last_updated
  FROM part),
kept AS (
  SELECT * FROM typed WHERE regexp_matches(product_id, '\\S') AND regexp_matches(product_name, '\\S'))"""


# --- pages ---------------------------------------------------------------------------------------


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as page text."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("data/"), F.col("source"), F.lit(".pdf")).alias("source"),
        F.col("doc_id").cast("int").alias("page"),
        "text",
        F.concat(F.col("source"), F.lit(".pdf")).alias("file_name"),
    )


PAGES = """pages_in AS (
  SELECT source || '.pdf' AS file_name, doc_id::INTEGER AS page_number, text FROM documents)"""
# Fixed windows of 1000 characters, 100 shared.
FIXED = PAGES + """, fixed AS (
  SELECT file_name, page_number, (s.i // 900)::INTEGER AS pos, substring(text, s.i + 1, 1000) AS content
  FROM pages_in, LATERAL (SELECT unnest(range(0, greatest(length(text) - 100, 1)::BIGINT, 900)) AS i) s
  WHERE length(text) > 0)"""


def hash_counts(text: str, key: str, source: str, dim: int = 256) -> str:
    """SQL for (key, bucket, n): token counts per md5 bucket."""
    return f"""counts AS (
  SELECT {key}, (('0x' || substring(md5(token), 1, 8))::BIGINT % {dim})::INTEGER AS bucket, count(*) AS n
  FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[ \\t\\n\\r\\f]+')) AS token FROM {source})
  WHERE token <> '' GROUP BY ALL),
weights AS (
  SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM counts)"""
