from __future__ import annotations

from pyspark.sql import functions as F

from quillvec.functions import vector as V
from quillvec.functions.sql import register_functions
from quillvec.operators import ann, search
from quillvec.operators.clean import resolve_content
from quillvec.operators.present import similarity_4dp
from quillvec.queries import inputs
from quillvec.queries.inputs import HITS, MEAN, PAIRS, PRODUCTS
from quillvec.queries.registry import query
from quillvec.session import scratch_path
from quillvec.sources.readers import load_corpus
from quillvec.sources.sinks import append_corpus


def ranked_4dp(found):
    return found.select("query_id", "id", "rank", similarity_4dp(F.col("similarity")).alias("similarity"))


RANKED_SQL = f"""WITH {HITS}
SELECT query_id, id, rank::INTEGER AS rank, round(sim, 4) AS similarity FROM hits WHERE rank <= top_k"""


@query("search_batch", RANKED_SQL)
def search_batch(spark, sf):
    return ranked_4dp(search.search_batch(inputs.corpus(spark, sf), inputs.requests(spark, sf)))


@query("search_block", RANKED_SQL)
def search_block(spark, sf):
    return ranked_4dp(search.search_block(inputs.corpus(spark, sf), inputs.requests(spark, sf)))


@query("search_json", RANKED_SQL)
def search_json(spark, sf):
    """Half of the vectors exist only as JSON text."""
    native = F.when(F.col("id") % 2 == 0, F.col("embedding"))
    text = F.when(F.col("id") % 2 == 1, V.vector_to_json(F.col("embedding")))
    stored = inputs.corpus(spark, sf).select("id", native.alias("embedding"), text.alias("vector_json"))
    rows = stored.withColumn("embedding", V.resolve_vector(F.col("embedding"), F.col("vector_json")))
    return ranked_4dp(search.search_batch(rows, inputs.requests(spark, sf)))


@query("search_topk", f"""WITH {MEAN}, scored AS (
  SELECT vec_id AS id, label, list_cosine_similarity(qv, embedding::DOUBLE[]) AS sim FROM embeddings, mean)
SELECT id, label, round(sim, 4) AS similarity FROM scored WHERE sim >= 0.05 ORDER BY sim DESC, id LIMIT 10""")
def search_topk(spark, sf):
    found = search.search_topk(inputs.corpus(spark, sf), inputs.mean_vector(spark, sf), 10, 0.05, ["label"])
    return found.select("id", "label", similarity_4dp(F.col("similarity")).alias("similarity"))


@query("search_l2", f"""WITH {PAIRS.replace("list_cosine_similarity(r.qv", "list_distance(r.qv")}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim, id) AS rank FROM pairs)
SELECT query_id, id, rank::INTEGER AS rank, round(sim * sim, 4) AS distance_sq FROM ordered WHERE rank <= 4""")
def search_l2(spark, sf):
    found = search.search_l2(inputs.corpus(spark, sf), inputs.requests(spark, sf))
    return found.withColumn("distance_sq", F.round("distance_sq", 4))


@query("cross_requests", f"""WITH {PAIRS}
SELECT query_id, threshold, count(*) FILTER (sim >= threshold) AS matched,
       round(max(sim) FILTER (sim >= threshold), 4) AS best_similarity
FROM pairs GROUP BY query_id, threshold""")
def cross_requests(spark, sf):
    found = search.cross_requests(inputs.corpus(spark, sf), inputs.requests(spark, sf))
    return found.withColumn("best_similarity", similarity_4dp(F.col("best_similarity")))


@query("match_counts", f"""WITH {PAIRS}
SELECT query_id, count(*) FILTER (sim >= threshold) AS matched,
       count(*) FILTER (sim >= threshold) >= 2 AS has_multiple,
       count(*) FILTER (sim >= threshold) >= 3 AS show_suggestions
FROM pairs GROUP BY query_id""")
def match_counts(spark, sf):
    return search.match_counts(inputs.corpus(spark, sf), inputs.requests(spark, sf))


def _neighbours(spark, sf):
    """Each vector beside the next one; some next vectors are cut short or zeroed."""
    here = inputs.corpus(spark, sf).select("id", F.col("embedding").alias("a"))
    nxt = inputs.corpus(spark, sf).select(
        (F.col("id") - 1).alias("id"),
        F.when(F.col("id") % 10 == 0, F.slice("embedding", 1, 32))
        .when(F.col("id") % 15 == 1, F.transform("embedding", lambda x: (x * 0).cast("float")))
        .otherwise(F.col("embedding"))
        .alias("b"),
    )
    return here.join(nxt, "id")


@query("vector_scalars", """WITH nxt AS (
  SELECT vec_id - 1 AS id, embedding::DOUBLE[] AS b, vec_id % 10 = 0 AS short, vec_id % 15 = 1 AS zero FROM embeddings),
scored AS (
  SELECT e.vec_id AS id,
         CASE WHEN short OR zero THEN 0.0::DOUBLE ELSE list_cosine_similarity(e.embedding::DOUBLE[], b) END AS sim
  FROM embeddings e JOIN nxt ON e.vec_id = nxt.id)
SELECT id, round(sim, 4) AS similarity, round(1.0 - sim, 4) AS distance FROM scored""")
def vector_scalars(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, sf).select(
        "id",
        F.round(V.cosine_similarity(a, b), 4).alias("similarity"),
        F.round(V.cosine_distance(a, b), 4).alias("distance"),
    )


@query("vector_json", """SELECT vec_id AS id, vec_id % 9 <> 0 AS parsed,
  CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 9 = 1 THEN 0 ELSE len(embedding) END::INTEGER AS size,
  CASE WHEN vec_id % 9 > 1 THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total
FROM embeddings""")
def vector_json(spark, sf):
    """Vectors through JSON and back; some texts are broken, some hold an empty array."""
    text = (
        F.when(F.col("id") % 9 == 0, F.lit("[0.1, oops"))
        .when(F.col("id") % 9 == 1, F.lit("[]"))
        .otherwise(V.vector_to_json(F.col("embedding")))
    )
    parsed = inputs.corpus(spark, sf).select("id", V.vector_from_json(text).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return parsed.select(
        "id",
        F.col("v").isNotNull().alias("parsed"),
        F.size("v").alias("size"),
        F.when(F.size("v") > 0, F.round(total, 4)).alias("total"),
    )


@query("vector_format", """SELECT vec_id AS id,
  '[' || array_to_string([printf('%.6f', x::DOUBLE) for x in embedding], ',') || ']' AS vector_text FROM embeddings""")
def vector_format(spark, sf):
    return inputs.corpus(spark, sf).select("id", V.vector_to_string(F.col("embedding")).alias("vector_text"))


@query("resolve_vector", """SELECT vec_id AS id,
  CASE WHEN vec_id % 3 = 0 THEN 'native' WHEN vec_id % 3 = 1 THEN 'json' ELSE 'none' END AS origin,
  CASE WHEN vec_id % 3 < 2 THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total FROM embeddings""")
def resolve_vector(spark, sf):
    kind = F.col("id") % 3
    stored = inputs.corpus(spark, sf).select(
        "id",
        F.when(kind == 0, F.col("embedding")).alias("embedding"),
        F.when(kind == 1, V.vector_to_json(F.col("embedding"))).alias("vector_json"),
    )
    v = V.resolve_vector(F.col("embedding"), F.col("vector_json"))
    origin = F.when(F.col("embedding").isNotNull(), "native").when(F.col("v").isNotNull(), "json").otherwise("none")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return stored.withColumn("v", v).select("id", origin.alias("origin"), F.round(total, 4).alias("total"))


@query("dimension_check", """SELECT vec_id % 4 = 0 AS shortened, count(*) AS rows_seen,
  count(*) FILTER (vec_id % 4 <> 0) AS rows_ok, count(*) FILTER (vec_id % 4 = 0) AS mismatches
FROM embeddings GROUP BY ALL""")
def dimension_check(spark, sf):
    cut = F.col("id") % 4 == 0
    v = F.when(cut, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    ok = V.dimension_ok(F.col("v"), 64)
    rows = inputs.corpus(spark, sf).select(cut.alias("shortened"), v.alias("v"))
    return rows.groupBy("shortened").agg(
        F.count("*").alias("rows_seen"), F.count_if(ok).alias("rows_ok"), F.count_if(~ok).alias("mismatches")
    )


@query("l2_normalized", """WITH scaled AS (
  SELECT vec_id AS id, [(x::DOUBLE * (vec_id % 4))::FLOAT for x in embedding] AS v FROM embeddings),
cells AS (
  SELECT id, generate_subscripts(v, 1) - 1 AS pos, unnest(v)::DOUBLE AS x FROM scaled),
norms AS (SELECT id, pos, x, sqrt(sum(x * x) OVER (PARTITION BY id)) AS n FROM cells)
SELECT id, pos::INTEGER AS pos, round(CASE WHEN n = 0 THEN 0.0 ELSE (x / n)::FLOAT::DOUBLE END, 4) + 0.0 AS x FROM norms""")
def l2_normalized(spark, sf):
    scaled = F.transform("embedding", lambda x: (x.cast("double") * (F.col("id") % 4)).cast("float"))
    unit = V.l2_normalize(F.col("v"))
    cells = inputs.corpus(spark, sf).select("id", scaled.alias("v")).select("id", F.posexplode(unit).alias("pos", "x"))
    return cells.select("id", "pos", (F.round(F.col("x").cast("double"), 4) + F.lit(0.0)).alias("x"))


@query("similarity_threshold", f"""WITH {MEAN}, scored AS (
  SELECT vec_id AS id, list_cosine_similarity(qv, embedding::DOUBLE[]) AS sim FROM embeddings, mean)
SELECT id, round(sim, 4) AS similarity FROM scored WHERE sim >= 0.02""")
def similarity_threshold(spark, sf):
    rows = inputs.corpus(spark, sf)
    center = F.array(*[F.lit(x) for x in inputs.mean_vector(spark, sf)]).cast("array<float>")
    scored = rows.select("id", V.cosine_similarity(center, F.col("embedding")).alias("sim"))
    return scored.filter(F.col("sim") >= 0.02).select("id", F.round("sim", 4).alias("similarity"))


HYBRID_PAYLOAD = ["product_id", "product_name", "category", "price", "stock_quantity"]


@query("search_hybrid", f"""WITH {PRODUCTS}, {MEAN}, scored AS (
  SELECT p.*, list_cosine_similarity(qv, embedding::DOUBLE[]) AS sim
  FROM products p, mean WHERE embedding IS NOT NULL AND category = 'ECONOMY' AND price BETWEEN 900.5 AND 990)
SELECT id, product_id, product_name, category, price::DOUBLE AS price, stock_quantity,
       round(sim, 4) AS similarity_score, round(1.0 - sim, 4) AS distance
FROM scored WHERE 1.0 - sim <= 1.0 - 0.01::DOUBLE ORDER BY sim DESC, id LIMIT 10""")
def search_hybrid(spark, sf):
    found = search.search_hybrid(
        inputs.products(spark, sf), inputs.mean_vector(spark, sf), threshold=0.01, top_n=10,
        category="ECONOMY", min_price=900.5, max_price=990, payload=HYBRID_PAYLOAD,
    )
    return _rounded_hybrid(found)


def _rounded_hybrid(found):
    return found.withColumns(
        {
            "price": F.col("price").cast("double"),
            "similarity_score": F.round("similarity_score", 4),
            "distance": F.round("distance", 4),
        }
    )


@query("search_hybrid_batch", f"""WITH {PRODUCTS}, req AS (
  SELECT e.vec_id AS query_id, e.embedding::DOUBLE[] AS qv, 3 + label % 5 AS top_k,
         CASE WHEN label % 4 <> 0 THEN p.p_type END AS want,
         CASE WHEN label % 3 <> 0 THEN p.p_retailprice::DECIMAL(18,2) - 30 END AS lo,
         CASE WHEN label % 2 <> 0 THEN p.p_retailprice::DECIMAL(18,2) + 30 END AS hi
  FROM embeddings e LEFT JOIN part p ON e.vec_id = p.p_partkey),
scored AS (
  SELECT r.query_id, r.top_k, p.*, list_cosine_similarity(r.qv, p.embedding::DOUBLE[]) AS sim
  FROM req r JOIN products p ON p.embedding IS NOT NULL AND (want IS NULL OR category = want)
   AND (lo IS NULL OR price >= lo) AND (hi IS NULL OR price <= hi)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank
  FROM scored WHERE sim >= 0.1)
SELECT query_id, id, rank::INTEGER AS rank, product_id, product_name, category, price::DOUBLE AS price,
       stock_quantity, round(sim, 4) AS similarity_score, round(1.0 - sim, 4) AS distance
FROM ordered WHERE rank <= top_k""")
def search_hybrid_batch(spark, sf):
    """Every vector asks for products of its part's category and price band; some filters are off."""
    part = inputs.table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), "p_type", F.col("p_retailprice").cast("decimal(18,2)").alias("p")
    )
    asked = inputs.requests(spark, sf).join(part, "query_id", "left").select(
        "query_id", "query_vec", "top_k", F.lit(0.1).alias("threshold"),
        F.when(F.col("label") % 4 != 0, F.col("p_type")).alias("category"),
        F.when(F.col("label") % 3 != 0, F.col("p") - 30).alias("min_price"),
        F.when(F.col("label") % 2 != 0, F.col("p") + 30).alias("max_price"),
    )
    return _rounded_hybrid(search.search_hybrid_batch(inputs.products(spark, sf), asked, HYBRID_PAYLOAD))


@query("search_hybrid_columns", f"""WITH {PRODUCTS}, {MEAN}, scored AS (
  SELECT p.*, list_cosine_similarity(qv, embedding::DOUBLE[]) AS sim FROM products p, mean WHERE embedding IS NOT NULL)
SELECT id, product_id, product_name, category, description, price::DOUBLE AS price, stock_quantity,
       '2024-03-0' || (id % 9 + 1) AS last_updated, product_name || ', ' || category AS full_text_context,
       round(sim, 4) AS similarity_score, round(1.0 - sim, 4) AS distance
FROM scored WHERE sim >= 0.01 ORDER BY sim DESC, id LIMIT 10""")
def search_hybrid_columns(spark, sf):
    """The columns that a hybrid search returns by default."""
    products = inputs.products(spark, sf).withColumns(
        {
            "last_updated": F.to_timestamp(F.concat(F.lit("2024-03-0"), (F.col("id") % 9 + 1).cast("string"))),
            "full_text_context": F.concat_ws(", ", "product_name", "category"),
        }
    )
    found = search.search_hybrid(products, inputs.mean_vector(spark, sf), threshold=0.01)
    return _rounded_hybrid(found).withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd"))


@query("search_stored_by_id", f"""WITH {HITS}
SELECT query_id, h.id, rank::INTEGER AS rank, round(sim, 4) AS similarity, e.label FROM hits h JOIN embeddings e ON h.id = e.vec_id WHERE rank <= top_k""")
def search_stored_by_id(spark, sf):
    """A corpus stored in folders of ids; payloads come from the folders that hold winners."""
    location = scratch_path(spark, "by-id")
    append_corpus(search.with_id_bucket(inputs.corpus(spark, sf)), location, "overwrite", partition_by=["id_bucket"])
    found = search.search_batch(load_corpus(spark, location), inputs.requests(spark, sf), ["label"])
    return found.withColumn("similarity", similarity_4dp(F.col("similarity")))


@query("optional_filters", f"""WITH {PRODUCTS}
SELECT id, category, price::DOUBLE AS price FROM products WHERE category = 'PROMO' AND price >= 901 AND price <= 960.5""")
def optional_filters(spark, sf):
    kept = search.optional_filters(inputs.products(spark, sf), "PROMO", 901, 960.5)
    return kept.select("id", "category", F.col("price").cast("double").alias("price"))


@query("attach_embeddings", f"""WITH {PRODUCTS}
SELECT id, product_id, price::DOUBLE AS price, len(embedding)::INTEGER AS dim,
       round(list_sum(embedding::DOUBLE[]), 4) AS total FROM products""")
def attach_embeddings(spark, sf):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return inputs.products(spark, sf).select(
        "id", "product_id", F.col("price").cast("double").alias("price"),
        F.size("embedding").alias("dim"), F.round(total, 4).alias("total"),
    )


@query("has_embedding", f"""WITH {PRODUCTS}
SELECT id, product_id FROM products WHERE embedding IS NOT NULL AND len(embedding) > 0""")
def has_embedding(spark, sf):
    return inputs.products(spark, sf).filter(V.has_embedding(F.col("embedding"))).select("id", "product_id")


@query("resolve_content", f"""WITH {PRODUCTS}
SELECT id, description AS content, category AS file_name, len(embedding)::INTEGER AS dim,
       NULL::INTEGER AS page_number, NULL::INTEGER AS chunk_index FROM products""")
def resolve_contract(spark, sf):
    """The catalogue mapped onto the corpus contract; `description` wins as its content."""
    shelf = inputs.products(spark, sf).withColumnRenamed("product_name", "Name")
    rows = resolve_content(shelf, {"id": "id", "embedding": "embedding", "file_name": "category"})
    return rows.withColumn("dim", F.size("embedding")).drop("embedding")


@query("retrieve_multi_table", f"""WITH {PAIRS}, named AS (
  SELECT *, CASE WHEN label % 2 = 0 THEN 'even_rows' ELSE 'odd_rows' END AS table_name FROM pairs),
allowed AS (
  SELECT * FROM named WHERE sim >= threshold AND (qlabel % 3 = 0 OR table_name = 'odd_rows')),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, table_name, id) AS rank FROM allowed)
SELECT query_id, table_name, id, rank::INTEGER AS rank, round(sim, 4) AS similarity FROM hits WHERE rank <= top_k""")
def retrieve_multi_table(spark, sf):
    """Two tables searched as one; two thirds of the labels ask one table only."""
    rows = inputs.corpus(spark, sf)
    tables = {"odd_rows": rows.filter("label % 2 = 1"), "even_rows": rows.filter("label % 2 = 0")}
    only = F.when(F.col("label") % 3 != 0, F.array(F.lit("odd_rows"))).otherwise(F.array().cast("array<string>"))
    asked = inputs.requests(spark, sf).withColumn("table_names", only)
    found = search.retrieve_multi_table(tables, asked)
    return found.select(
        "query_id", "table_name", "id", "rank", similarity_4dp(F.col("similarity")).alias("similarity")
    )


def _chosen(spark, sf):
    """Each request with the ids it picked: itself, two neighbours and one that does not exist; some picked none."""
    q = F.col("query_id")
    ids = F.when(F.col("label") % 4 != 0, F.array(q, q + 1, q + 7, F.lit(-5).cast("long")))
    return inputs.requests(spark, sf).withColumn("selected_ids", ids)


CHOSEN = f"""WITH {PAIRS}, chosen AS (
  SELECT * FROM pairs WHERE qlabel % 4 <> 0 AND id IN (query_id, query_id + 1, query_id + 7))"""


@query("retrieve_selected", f"""{CHOSEN}
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INTEGER AS rank,
       round(sim, 4) AS similarity FROM chosen WHERE sim >= -0.05""")
def retrieve_selected(spark, sf):
    asked = _chosen(spark, sf).withColumn("threshold", F.lit(-0.05))
    return ranked_4dp(search.retrieve_selected(inputs.corpus(spark, sf), asked))


@query("filter_selected_ids", f"""WITH {HITS}, top AS (SELECT * FROM hits WHERE rank <= top_k)
SELECT query_id, id, rank::INTEGER AS rank FROM top
WHERE qlabel % 4 = 0 OR id IN (query_id, query_id + 1, query_id + 7)""")
def filter_selected(spark, sf):
    asked = _chosen(spark, sf)
    found = search.search_batch(inputs.corpus(spark, sf), asked)
    return search.restrict_to_selection(found, asked).select("query_id", "id", "rank")


CELLS = 16


def _cells(spark, sf):
    """A stored index: nine tenths of the corpus build it, the others are added later."""
    rows, location = inputs.corpus(spark, sf).drop("label"), scratch_path(spark, "index")
    ann.build_index(rows.filter(F.col("id") % 10 != 3), location, CELLS)
    ann.add_to_index(rows.filter(F.col("id") % 10 == 3), location)
    return ann.open_index(spark, location)


@query("search_ann")
def search_ann(spark, sf):
    """Every vector asks its eleven nearest cells of sixteen."""
    indexed, centroids = _cells(spark, sf)
    return ranked_4dp(ann.search_ann(indexed, inputs.requests(spark, sf), centroids, probes=11))


@query("search_ann_every_cell", RANKED_SQL)
def search_ann_every_cell(spark, sf):
    """With all cells probed the approximate search is exact."""
    indexed, centroids = _cells(spark, sf)
    return ranked_4dp(ann.search_ann(indexed, inputs.requests(spark, sf), centroids, probes=CELLS))


@query("ann_recall", f"""WITH {HITS} SELECT count(*) AS exact_rows, TRUE AS mostly_found FROM hits WHERE rank <= top_k""")
def ann_recall(spark, sf):
    indexed, centroids = _cells(spark, sf)
    asked = inputs.requests(spark, sf)
    exact = search.search_batch(inputs.corpus(spark, sf), asked)
    found = ann.recall_at_k(ann.search_ann(indexed, asked, centroids, probes=11), exact)
    return found.select("exact_rows", (F.col("recall") >= 0.9).alias("mostly_found"))


@query("sql_functions", """WITH nxt AS (SELECT vec_id - 1 AS id, embedding::DOUBLE[] AS b FROM embeddings)
SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], b), 4) AS similarity,
       round(1.0 - list_cosine_similarity(e.embedding::DOUBLE[], b), 4) AS distance
FROM embeddings e JOIN nxt ON e.vec_id = nxt.id""")
def sql_functions(spark, sf):
    """The vector functions called from SQL text."""
    register_functions(spark)
    inputs.corpus(spark, sf).createOrReplaceTempView("quillvec_vectors")
    return spark.sql("""
        SELECT a.id, round(cosine_similarity(a.embedding, b.embedding), 4) AS similarity,
               round(cosine_distance(a.embedding, b.embedding), 4) AS distance
        FROM quillvec_vectors a JOIN quillvec_vectors b ON a.id = b.id - 1""")
