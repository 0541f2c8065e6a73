from __future__ import annotations

from pyspark.sql import functions as F

from quillvec.functions import encode, text
from quillvec.functions.chunker import chunk_recursive as chunk_recursive_of
from quillvec.functions.sql import register_functions
from quillvec.operators import chunks, stats
from quillvec.operators.clean import nonblank_text
from quillvec.operators.present import keyword_match
from quillvec.queries import inputs
from quillvec.queries.inputs import FIXED, hash_counts
from quillvec.queries.registry import query
from quillvec.queries.retrieval import preview_sql

DIM = 256


def _nonzero(rows, key):
    cells = rows.select(key, F.posexplode("embedding").alias("bucket", "w")).filter("w <> 0")
    return cells.select(key, "bucket", F.round(F.col("w").cast("double"), 5).alias("w"))


VECTOR_SQL = f"""WITH {hash_counts("text", "doc_id", "documents")}
SELECT doc_id, bucket, round(w::FLOAT::DOUBLE, 5) AS w FROM weights"""


@query("chunk_fixed", f"WITH {FIXED} SELECT file_name, page_number, pos, content FROM fixed")
def chunk_fixed(spark, sf):
    return chunks.chunk_pages(inputs.pages(spark, sf), "fixed")


@query("chunk_metadata", f"""WITH {FIXED}
SELECT file_name, page_number, pos, length(content) AS n_chars,
       row_number() OVER (ORDER BY file_name, page_number, pos) - 1 AS chunk_index FROM fixed""")
def chunk_metadata(spark, sf):
    numbered = chunks.chunk_metadata(inputs.pages(spark, sf), "fixed")
    return numbered.select(
        "file_name", "page_number", "pos", F.char_length("content").cast("long").alias("n_chars"), "chunk_index"
    )


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    return chunks.chunk_pages(inputs.pages(spark, sf), "recursive")


@query("chunk_recursive_cover", """SELECT doc_id::INTEGER AS page_number, md5(regexp_replace(text, '\\s', '', 'g')) AS letters,
  length(regexp_replace(text, '\\s', '', 'g')) AS n_letters FROM documents""")
def chunk_recursive_cover(spark, sf):
    """Without overlap the chunks of a page hold each of its letters once, in order."""
    page = inputs.pages(spark, sf).select("page", "text")
    joined = F.array_join(chunk_recursive_of(F.col("text"), 300, 0), "")
    letters = F.regexp_replace(joined, r"\s", "")
    return page.select(
        F.col("page").alias("page_number"), F.md5(letters).alias("letters"),
        F.char_length(letters).cast("long").alias("n_letters"),
    )


@query("chunk_recursive_defaults", """SELECT doc_id::INTEGER AS page_number, TRUE AS no_chunk_too_long, TRUE AS none_blank,
  TRUE AS all_in_page, TRUE AS enough, TRUE AS in_order FROM documents WHERE regexp_matches(text, '\\S')""")
def chunk_recursive_defaults(spark, sf):
    """The rules of chunks of 1000 characters with an overlap of 100, page by page."""
    page = inputs.pages(spark, sf).select("page", "text").withColumn("chunks", chunk_recursive_of(F.col("text"), 1000, 100))
    at = F.transform("chunks", lambda c: F.instr(F.col("text"), c))
    letters = F.char_length(F.regexp_replace("text", r"^\s+|\s+$", ""))
    return page.where(F.col("text").rlike(r"\S")).withColumn("at", at).select(
        F.col("page").alias("page_number"),
        F.forall("chunks", lambda c: F.char_length(c) <= 1000).alias("no_chunk_too_long"),
        F.forall("chunks", lambda c: c.rlike(r"\S")).alias("none_blank"),
        F.forall("at", lambda i: i > 0).alias("all_in_page"),
        (F.size("chunks") >= F.ceil(letters / 1000)).alias("enough"),
        # A copy of a chunk may stand earlier in the page, so the first and last are compared.
        (F.element_at("at", 1) <= F.element_at("at", -1)).alias("in_order"),
    )


@query("sql_embeddings", VECTOR_SQL)
def sql_embeddings(spark, sf):
    """The encoder called from SQL text."""
    register_functions(spark, encode.hashed_encoder(DIM))
    inputs.table(spark, sf, "documents").createOrReplaceTempView("quillvec_documents")
    return _nonzero(spark.sql("SELECT doc_id, generate_embeddings(text) AS embedding FROM quillvec_documents"), "doc_id")


@query("chunk_turns")
def chunk_turns(spark, sf):
    """Conversations as files, turns as pages, in small chunks."""
    turns = inputs.table(spark, sf, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("file_name"),
        F.col("turn").cast("int").alias("page"),
        "text",
    )
    return chunks.chunk_pages(turns, "recursive", 200, 40)


@query("chunk_load_summary", f"""WITH {FIXED}
SELECT (SELECT count(*) FROM pages_in) AS total_documents, count(*) AS total_chunks,
       count(DISTINCT file_name) AS total_files, 'success' AS status, NULL::VARCHAR AS message FROM fixed""")
def chunk_load_summary(spark, sf):
    pages = inputs.pages(spark, sf)
    return stats.chunk_load_summary(pages, chunks.chunk_pages(pages, "fixed"))


@query("loaded_files", f"WITH {FIXED} SELECT DISTINCT file_name FROM fixed")
def loaded_files(spark, sf):
    return stats.loaded_files(chunks.chunk_pages(inputs.pages(spark, sf), "fixed"))


@query("vectorize_hashed", VECTOR_SQL)
def vectorize_hashed(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    return _nonzero(docs.select("doc_id", encode.hashed_vector(F.col("text"), DIM).alias("embedding")), "doc_id")


@query("vectorize", VECTOR_SQL)
def vectorize(spark, sf):
    """The pluggable encoder slot, filled with the hashed encoder."""
    docs = inputs.table(spark, sf, "documents")
    vectors = encode.vectorize(F.col("text"), encode.hashed_encoder(DIM))
    return _nonzero(docs.select("doc_id", vectors.alias("embedding")), "doc_id")


@query("embed_nonblank", f"""WITH blanked AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN '  ' WHEN 4 THEN NULL ELSE text END AS text FROM documents),
{hash_counts("text", "doc_id", "blanked")}
SELECT b.doc_id, any_value(w.doc_id) IS NOT NULL AS encoded,
       CASE WHEN any_value(w.doc_id) IS NULL THEN NULL ELSE {DIM} END::INTEGER AS dim, count(w.bucket) AS buckets
FROM blanked b LEFT JOIN weights w USING (doc_id) GROUP BY b.doc_id""")
def embed_nonblank(spark, sf):
    """Blank and missing texts get no vector, and every row keeps its own."""
    kind = F.col("doc_id") % 6
    body = F.when(kind == 2, F.lit("  ")).when(kind != 4, F.col("text"))
    docs = inputs.table(spark, sf, "documents").select("doc_id", body.alias("text"))
    vectors = docs.select("doc_id", encode.vectorize(F.col("text"), encode.hashed_encoder(DIM)).alias("v"))
    buckets = F.size(F.filter("v", lambda x: x != 0))
    return vectors.select(
        "doc_id",
        F.col("v").isNotNull().alias("encoded"),
        F.size("v").alias("dim"),
        F.coalesce(buckets, F.lit(0)).cast("long").alias("buckets"),
    )


def _touchy_encoder():
    """Refuses texts that contain `the`, as a remote encoder may refuse one text of a batch."""
    inner = encode.hashed_encoder(DIM)()

    def run(texts):
        if any("the" in t for t in texts):
            raise ValueError("refused text")
        return inner(texts)

    return run


@query("embed_isolated", f"""SELECT doc_id, CASE WHEN contains(text, 'the') THEN 0 ELSE {DIM} END::INTEGER AS dim,
  CASE WHEN contains(text, 'the') THEN 'ValueError: refused text' END AS error FROM documents""")
def embed_isolated(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    out = docs.select("doc_id", encode.vectorize_isolated(F.col("text"), _touchy_encoder).alias("r"))
    return out.select("doc_id", F.size("r.vector").alias("dim"), F.col("r.error").alias("error"))


@query("align_batches", """SELECT d.doc_id, d.lang, e.vec_id IS NOT NULL AS paired, len(e.embedding)::INTEGER AS dim
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def align_batches(spark, sf):
    """Texts and vectors that arrive apart are paired by row id, never by position."""
    vectors = inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    joined = inputs.table(spark, sf, "documents").select("doc_id", "lang").join(vectors, "doc_id", "left")
    return joined.select("doc_id", "lang", F.col("embedding").isNotNull().alias("paired"), F.size("embedding").alias("dim"))


@query("combined_text", """SELECT c_custkey,
  concat_ws(' | ', CASE WHEN c_custkey % 3 <> 1 THEN 'name: ' || c_name END, 'segment: ' || c_mktsegment,
            CASE WHEN c_custkey % 4 <> 2 THEN 'balance: ' || c_custkey || ' units' END) AS combined FROM customer""")
def combined_text(spark, sf):
    key = F.col("c_custkey")
    rows = inputs.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(key % 3 != 1, F.concat(F.lit(" "), F.col("c_name"), F.lit("\n"))).alias("name"),
        F.concat(F.lit("\t"), F.col("c_mktsegment")).alias("segment"),
        F.when(key % 4 != 2, F.concat(key.cast("string"), F.lit(" units"))).otherwise(F.lit("  ")).alias("balance"),
    )
    return rows.select("c_custkey", text.combined_text(["name", "segment", "balance"]).alias("combined"))


@query("full_text_context", """SELECT p_partkey,
  concat_ws('. ', CASE WHEN p_partkey % 6 <> 1 THEN 'Product: ' || p_name END,
            CASE WHEN p_partkey % 5 <> 1 THEN 'Category: ' || p_type END, 'Description: ' || p_brand,
            CASE WHEN p_partkey % 7 <> 1 THEN 'Price: $' || printf('%,.2f', p_retailprice * 3) END) || '.' AS context
FROM part""")
def full_text_context(spark, sf):
    key = F.col("p_partkey")
    name = F.when(key % 6 != 1, F.col("p_name"))
    category = F.when(key % 5 != 1, F.col("p_type")).otherwise(F.lit(" "))
    price = F.when(key % 7 != 1, (F.col("p_retailprice") * 3).cast("decimal(18,2)"))
    context = text.full_text_context(name, category, F.col("p_brand"), price)
    return inputs.table(spark, sf, "part").select("p_partkey", context.alias("context"))


@query("preview", f"""SELECT doc_id, {preview_sql("text", 200)} AS short_preview, {preview_sql("text", 300)} AS long_preview
FROM documents""")
def preview(spark, sf):
    return inputs.table(spark, sf, "documents").select(
        "doc_id",
        text.preview(F.col("text"), 200).alias("short_preview"),
        text.preview(F.col("text"), 300).alias("long_preview"),
    )


@query("keyword_match", """SELECT doc_id, lang FROM documents WHERE text ILIKE '%THERE%' ORDER BY doc_id LIMIT 10""")
def keyword(spark, sf):
    return keyword_match(inputs.table(spark, sf, "documents"), "THERE", 10, "text", "doc_id").select("doc_id", "lang")


@query("nonblank_text", """SELECT doc_id, length(text) AS n_chars FROM documents WHERE doc_id % 5 <> 2""")
def nonblank(spark, sf):
    body = F.when(F.col("doc_id") % 5 == 2, F.lit(" \n\t ")).otherwise(F.col("text"))
    rows = inputs.table(spark, sf, "documents").select("doc_id", body.alias("text"))
    return nonblank_text(rows).select("doc_id", F.char_length("text").cast("long").alias("n_chars"))


@query("table_name_from_file", """SELECT url,
  'web_' || translate(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1'), ' -', '__') AS table_name
FROM pages""")
def table_name(spark, sf):
    return inputs.table(spark, sf, "pages").select(
        "url", text.table_name_from_file(F.col("url"), "web").alias("table_name")
    )
