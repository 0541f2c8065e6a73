from __future__ import annotations

from pyspark.sql import functions as F

from quillvec.functions.vector import vector_to_json
from quillvec.operators import stats
from quillvec.operators.clean import profile_columns
from quillvec.queries import inputs
from quillvec.queries.inputs import PRODUCTS
from quillvec.queries.registry import query

STATS_SQL = """SELECT count(*) AS total_products, count(DISTINCT category) AS total_categories,
  sum(price)::DOUBLE AS total_value, round(avg(price)::DOUBLE, 4) AS average_price, min(price)::DOUBLE AS min_price,
  max(price)::DOUBLE AS max_price, sum(stock_quantity)::BIGINT AS total_stock,
  round(avg(stock_quantity), 4) AS average_stock FROM products"""


def _plain(df):
    """Decimals as doubles, averages to four places."""
    kinds = dict(df.dtypes)
    out = {c: F.col(c).cast("double") for c in df.columns if kinds[c].startswith("decimal")}
    out |= {c: F.round(c, 4) for c in df.columns if c.startswith("average")}
    return df.withColumns(out)


@query("product_statistics", f"WITH {PRODUCTS} {STATS_SQL}")
def product_statistics(spark, sf):
    return _plain(stats.product_statistics(inputs.products(spark, sf).drop("embedding")))


@query("product_statistics_filtered", f"WITH {PRODUCTS} {STATS_SQL} WHERE category = 'STANDARD'")
def product_statistics_filtered(spark, sf):
    return _plain(stats.product_statistics(inputs.products(spark, sf).drop("embedding"), "STANDARD"))


@query("stats_by_category", """SELECT p_type AS category, count(*) AS n,
  sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS total, round(avg(p_retailprice::DECIMAL(18,2)), 4) AS average
FROM part GROUP BY p_type""")
def stats_by_category(spark, sf):
    rows = inputs.table(spark, sf, "part").withColumn("price", F.col("p_retailprice").cast("decimal(18,2)"))
    return _plain(stats.stats_by_category(rows, "p_type", "price"))


def _orders(spark, sf):
    """Orders with some dates missing."""
    when = F.when(F.col("o_orderkey") % 6 != 4, F.col("o_orderdate"))
    return inputs.table(spark, sf, "orders").select(
        "o_orderkey", when.alias("placed"), F.col("o_totalprice").cast("decimal(18,2)").alias("price")
    )


ORDERS = """WITH placed AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 4 THEN o_orderdate END AS placed,
         o_totalprice::DECIMAL(18,2) AS price FROM orders)"""


@query("stats_by_day", f"""{ORDERS}
SELECT strftime(placed, '%Y-%m-%d') AS day, count(*) AS n, sum(price)::DOUBLE AS total
FROM placed WHERE placed IS NOT NULL GROUP BY day ORDER BY day DESC""")
def stats_by_day(spark, sf):
    daily = _plain(stats.stats_by_day(_orders(spark, sf), "placed", "price"))
    return daily.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stats_by_month", f"""{ORDERS}
SELECT year(placed)::INTEGER AS year, month(placed)::INTEGER AS month, count(*) AS n, sum(price)::DOUBLE AS total
FROM placed WHERE placed IS NOT NULL GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC""")
def stats_by_month(spark, sf):
    return _plain(stats.stats_by_month(_orders(spark, sf), "placed", "price"))


@query("newest_first", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
ORDER BY o_orderdate DESC, o_orderkey""")
def newest_first(spark, sf):
    rows = stats.newest_first(inputs.table(spark, sf, "orders"), "o_orderdate", tie="o_orderkey")
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("embedding_coverage", f"""WITH {PRODUCTS}, audited AS (
  SELECT 'catalogue' AS table_name, embedding IS NOT NULL AS native, FALSE AS json, FALSE AS wrong FROM products
  UNION ALL SELECT 'vectors', vec_id % 3 = 0, vec_id % 3 = 1, FALSE FROM embeddings
  UNION ALL SELECT 'short_vectors', TRUE, FALSE, vec_id % 5 = 0 FROM embeddings
  UNION ALL SELECT 'texts', FALSE, FALSE, FALSE FROM documents)
SELECT table_name, count(*) AS total_rows, count(*) FILTER (native) AS with_vector, count(*) FILTER (json) AS with_json,
       count(*) FILTER (NOT native AND NOT json) AS without_vector, count(*) FILTER (wrong) AS wrong_dimension,
       count(*) > 0 AS ready, CASE WHEN count(*) FILTER (native OR json) = 0 THEN 'no row has a usable vector' END AS warning
FROM audited GROUP BY table_name""")
def embedding_coverage(spark, sf):
    rows = inputs.corpus(spark, sf)
    kind = F.col("id") % 3
    mixed = rows.select(
        F.when(kind == 0, F.col("embedding")).alias("embedding"),
        F.when(kind == 1, vector_to_json(F.col("embedding"))).alias("vector_json"),
    )
    cut = F.when(F.col("id") % 5 == 0, F.slice("embedding", 1, 12)).otherwise(F.col("embedding"))
    texts = inputs.table(spark, sf, "documents").select(F.lit(None).cast("array<float>").alias("embedding"))
    tables = {
        "catalogue": inputs.products(spark, sf),
        "vectors": mixed,
        "short_vectors": rows.select(cut.alias("embedding")),
        "texts": texts,
    }
    return stats.embedding_coverage(tables, 64)


@query("verify_load", """SELECT (SELECT count(*) FROM part) AS source_rows, (SELECT count(*) FROM embeddings) AS loaded_rows,
  count(*) AS missing_keys, FALSE AS complete FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)""")
def verify_load(spark, sf):
    """Parts as the source, vectors as what arrived."""
    source = inputs.table(spark, sf, "part").select(F.col("p_partkey").alias("key"))
    loaded = inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"))
    return stats.verify_load(source, loaded, "key")


@query("profile_columns", """SELECT * FROM (VALUES
  ('event_id', 'bigint', (SELECT count(event_id) FROM events), (SELECT max(length(event_id::VARCHAR)) FROM events), FALSE),
  ('user_id', 'bigint', (SELECT count(*) FILTER (event_id % 4 <> 0) FROM events),
     (SELECT max(length(user_id::VARCHAR)) FILTER (event_id % 4 <> 0) FROM events), TRUE),
  ('event_type', 'string', (SELECT count(event_type) FROM events), (SELECT max(length(event_type)) FROM events), FALSE),
  ('props', 'string', (SELECT count(props) FROM events), (SELECT max(length(props)) FROM events), FALSE))
  AS t(column_name, data_type, values_present, max_length, has_nulls)""")
def profile(spark, sf):
    user = F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("user_id")
    return profile_columns(inputs.table(spark, sf, "events").select("event_id", user, "event_type", "props"))
