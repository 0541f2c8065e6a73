from __future__ import annotations

from pyspark.sql import functions as F

from quillvec import constants as const
from quillvec.functions.encode import hashed_vector
from quillvec.operators import present, search
from quillvec.operators.clean import validate_requests
from quillvec.plans.answer import answer_prompts
from quillvec.queries import inputs
from quillvec.queries.inputs import CHUNKS, FILLED, HITS, hash_counts
from quillvec.queries.registry import query

# Every vector asks the chunk corpus; hits joined to the filled chunk columns.
FOUND = f"""WITH {HITS}, {FILLED}, found AS (
  SELECT h.query_id, h.qlabel, h.top_k, h.rank::INTEGER AS rank, h.sim, h.total, f.*
  FROM hits h JOIN filled f USING (id))"""


def found_rows(spark, sf):
    rows = inputs.chunk_rows(spark, sf)
    return present.default_fields(search.search_batch(rows, inputs.requests(spark, sf), present.CHUNK_PAYLOAD))


def preview_sql(column: str, n: int) -> str:
    return f"CASE WHEN length({column}) > {n} THEN substring({column}, 1, {n}) || '...' ELSE {column} END"


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def message_sql(template: str, n: str) -> str:
    """A message with a number in it, as SQL."""
    head, tail = template.split("{n}")
    return f"{_sql_text(head)} || {n} || {_sql_text(tail)}"


@query("suggest", f"""{FOUND}
SELECT query_id, rank AS index, id, content, {preview_sql("content", 300)} AS content_preview, file_name,
       page_number + 1 AS page_number, round(sim, 4) AS similarity, round(sim * 100, 2) AS similarity_percent
FROM found WHERE rank <= top_k""")
def suggest(spark, sf):
    return present.suggest(inputs.chunk_rows(spark, sf), inputs.requests(spark, sf))


@query("suggestion_replies", f"""{FOUND}, counted AS (
  SELECT query_id, least(total, top_k)::INTEGER AS n, string_agg(id || ':' || round(sim, 4)::DECIMAL(6,4), ',' ORDER BY rank) AS ids
  FROM found WHERE rank <= top_k GROUP BY query_id, total, top_k)
SELECT r.query_id, coalesce(n, 0)::INTEGER AS total_found, coalesce(n, 0) >= 4 AS has_multiple, ids,
       CASE WHEN n > 0 THEN {message_sql(const.FOUND_MESSAGE, "n")} ELSE {_sql_text(const.NOT_FOUND_MESSAGE)} END AS message
FROM req r LEFT JOIN counted USING (query_id)""")
def suggestion_replies(spark, sf):
    asked = inputs.requests(spark, sf)
    replies = present.suggestion_replies(present.suggest(inputs.chunk_rows(spark, sf), asked), asked, 4)
    item = F.transform(
        "suggestions",
        lambda s: F.concat_ws(":", s["id"].cast("string"), s["similarity"].cast("decimal(6,4)").cast("string")),
    )
    return replies.select("query_id", "total_found", "has_multiple", F.array_join(item, ",").alias("ids"), "message")


@query("retrieve_context", f"""{FOUND}, marked AS (
  SELECT *, rank <= top_k AS in_context, total >= 3 AND rank <= 10 AND qlabel % 2 = 0 AS in_suggestions FROM found)
SELECT query_id, id, rank, round(sim, 4) AS similarity, total AS total_available, in_context, in_suggestions,
       content, file_name, page_number, chunk_index
FROM marked WHERE in_context OR in_suggestions""")
def retrieve_context(spark, sf):
    asked = inputs.requests(spark, sf).withColumn("return_suggestions", F.col("label") % 2 == 0)
    found = present.retrieve_context(inputs.chunk_rows(spark, sf), asked)
    return found.withColumn("similarity", F.round("similarity", 4))


@query("chat_suggestions", f"""{FOUND}, block AS (
  SELECT * FROM found WHERE total >= 3 AND rank <= 10)
SELECT query_id, total AS total_available,
       string_agg(rank || '/' || id || '/' || file_name || '/' || (page_number + 1), ',' ORDER BY rank) AS items,
       {message_sql(const.CHAT_SUGGESTION_MESSAGE, "total")} AS message
FROM block GROUP BY query_id, total""")
def chat_suggestions(spark, sf):
    found = present.retrieve_context(inputs.chunk_rows(spark, sf), inputs.requests(spark, sf))
    item = F.transform(
        "suggestions", lambda s: F.concat_ws("/", s["index"], s["id"], s["file_name"], s["page_number"])
    )
    return present.chat_suggestions(found).select(
        "query_id", "total_available", F.array_join(item, ",").alias("items"), "message"
    )


@query("dedupe_sources", f"""{FOUND}, first AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, file_name, page_number ORDER BY rank) AS n
  FROM found WHERE rank <= top_k)
SELECT query_id, rank, id, file_name, page_number + 1 AS page_number,
       {preview_sql("content", 200)} AS content_preview, round(sim, 4) AS similarity FROM first WHERE n = 1""")
def dedupe_sources(spark, sf):
    return present.dedupe_sources(found_rows(spark, sf))


CONTEXTS = f"""{FOUND}, contexts AS (
  SELECT query_id, string_agg('[' || file_name || ', trang ' || (page_number + 1) || ']: ' || content, chr(10) || chr(10) ORDER BY rank) AS context,
         count(*) AS total_sources
  FROM found WHERE rank <= top_k GROUP BY query_id)"""


@query("assemble_context", f"{CONTEXTS} SELECT query_id, context, total_sources FROM contexts")
def assemble_context(spark, sf):
    return present.assemble_context(found_rows(spark, sf))


def prompt_sql(context: str, question: str) -> str:
    before, rest = const.PROMPT_TEMPLATE.split("{context}")
    between, after = rest.split("{question}")
    return f"{_sql_text(before)} || {context} || {_sql_text(between)} || {question} || {_sql_text(after)}"


@query("render_prompt", f"""{CONTEXTS}, strict AS (
  SELECT query_id, 'question ' || query_id AS question, CASE WHEN query_id % 10 <> 3 THEN query_id END AS answered FROM req)
SELECT s.query_id, {prompt_sql("context", "question")} AS prompt, coalesce(total_sources, 0) AS total_sources,
       context IS NULL AS no_results, CASE WHEN context IS NULL THEN {_sql_text(const.NO_ANSWER_MESSAGE)} END AS answer
FROM strict s LEFT JOIN contexts c ON s.answered = c.query_id""")
def render_prompt(spark, sf):
    """Some requests ask for more similarity than any row has."""
    asked = inputs.requests(spark, sf).withColumns(
        {
            "query": F.concat(F.lit("question "), F.col("query_id").cast("string")),
            "threshold": F.when(F.col("query_id") % 10 == 3, F.lit(1.5)).otherwise(F.col("threshold")),
        }
    )
    rows = search.search_batch(inputs.chunk_rows(spark, sf), asked, present.CHUNK_PAYLOAD)
    return present.render_prompt(present.assemble_context(present.default_fields(rows)), asked)


@query("format_scores", f"""{FOUND}
SELECT query_id, rank AS index, id, page_number + 1 AS page_number, round(sim, 4) AS similarity,
       round(sim * 100, 2) AS similarity_percent FROM found WHERE rank <= top_k""")
def format_scores(spark, sf):
    return present.format_scores(found_rows(spark, sf))


@query("similarity_band", f"""{FOUND}
SELECT CASE WHEN sim > 0.8 THEN 'high' WHEN sim >= 0.5 THEN 'medium' ELSE 'low' END AS band,
       count(*) AS n, round(min(sim), 4) AS lowest, round(max(sim), 4) AS highest
FROM found WHERE rank <= top_k GROUP BY band""")
def similarity_band(spark, sf):
    banded = found_rows(spark, sf).withColumn("band", present.similarity_band(F.col("similarity")))
    return banded.groupBy("band").agg(
        F.count("*").alias("n"),
        F.round(F.min("similarity"), 4).alias("lowest"),
        F.round(F.max("similarity"), 4).alias("highest"),
    )


@query("default_fields", f"""WITH {FILLED} SELECT id, length(content) AS n_chars, file_name, page_number, chunk_index FROM filled""")
def default_fields(spark, sf):
    rows = present.default_fields(inputs.chunk_rows(spark, sf))
    return rows.select(
        "id", F.char_length("content").cast("long").alias("n_chars"), "file_name", "page_number", "chunk_index"
    )


@query("filter_files", f"""WITH {CHUNKS}
SELECT id, file_name FROM chunks WHERE file_name IN ('src1', 'src3', 'src19')""")
def filter_files(spark, sf):
    return search.filter_files(inputs.chunk_rows(spark, sf), ["src1", "src3", "src19"]).select("id", "file_name")


def _conversation_requests(spark, sf):
    """Every benchmark item asks as text; top_k and threshold are missing here and there, and some break the limits."""
    key = F.col("item_id")
    return inputs.table(spark, sf, "benchmark").select(
        key.alias("query_id"),
        F.when(key % 9 == 4, F.repeat("text", 15)).otherwise(F.col("text")).alias("query"),
        F.when(key % 7 == 3, F.lit(25)).when(key % 3 != 0, F.lit(5)).alias("top_k"),
        F.when(F.col("item_id") % 4 != 0, F.lit(0.35)).alias("threshold"),
        F.lit(None).cast("int").alias("min_suggestions"),
    )


def document_corpus(spark, sf):
    """Whole documents as rows, encoded by token hashes."""
    docs = inputs.table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        hashed_vector(F.col("text")).alias("embedding"),
        F.col("source").alias("file_name"),
        F.lit(0).alias("page_number"),
        F.lit(0).alias("chunk_index"),
    )


@query("answer_prompts", f"""WITH requested AS (
  SELECT item_id AS query_id, CASE WHEN item_id % 9 = 4 THEN repeat(text, 15) ELSE text END AS query,
         CASE WHEN item_id % 7 = 3 THEN 25 WHEN item_id % 3 <> 0 THEN 5 ELSE 4 END AS top_k,
         CASE WHEN item_id % 4 <> 0 THEN 0.35 ELSE 0.5 END::DOUBLE AS threshold FROM benchmark),
judged AS (
  SELECT *, concat_ws('; ', CASE WHEN NOT regexp_matches(query, '\\S') THEN 'empty query' END,
    CASE WHEN length(query) > 1000 THEN 'query too long' END, CASE WHEN top_k > 20 THEN 'top_k out of range' END) AS reasons
  FROM requested),
asked AS (SELECT * FROM judged WHERE reasons = ''),
both_sides AS (
  SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'q' || query_id, query FROM asked),
{hash_counts("text", "key", "both_sides")},
sims AS (
  SELECT a.query_id, d.doc_id AS id, sum(q.w::FLOAT::DOUBLE * w.w::FLOAT::DOUBLE) AS product
  FROM asked a JOIN weights q ON q.key = 'q' || a.query_id
  JOIN weights w ON w.bucket = q.bucket JOIN documents d ON w.key = 'd' || d.doc_id
  GROUP BY ALL),
hits AS (
  SELECT a.query_id, a.top_k, id, row_number() OVER (PARTITION BY a.query_id ORDER BY round(product, 9) DESC, id) AS rank
  FROM sims JOIN asked a USING (query_id) WHERE product >= threshold),
contexts AS (
  SELECT query_id, count(*) AS total_sources, string_agg(id, ',' ORDER BY rank) AS source_ids,
         string_agg('[' || d.source || ', trang 1]: ' || d.text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN documents d ON hits.id = d.doc_id WHERE rank <= top_k GROUP BY query_id),
blocks AS (
  SELECT query_id, count(*) AS total_available,
         CASE WHEN count(*) >= 3 THEN string_agg(id, ',' ORDER BY rank) FILTER (WHERE rank <= 10) END AS suggestion_ids,
         CASE WHEN count(*) >= 3 THEN {message_sql(const.CHAT_SUGGESTION_MESSAGE, "count(*)")} END AS message
  FROM hits GROUP BY query_id)
SELECT a.query_id, {prompt_sql("context", "a.query")} AS prompt, coalesce(total_sources, 0) AS total_sources,
       context IS NULL AS no_results, CASE WHEN context IS NULL THEN {_sql_text(const.NO_ANSWER_MESSAGE)} END AS answer,
       coalesce(source_ids, '') AS source_ids, total_available, suggestion_ids, message, reasons
FROM asked a LEFT JOIN contexts c USING (query_id) LEFT JOIN blocks b USING (query_id)
UNION ALL SELECT query_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reasons FROM judged WHERE reasons <> ''""")
def answer_requests(spark, sf):
    """From request texts to prompts: check, encode, retrieve, assemble, render; one row per request."""
    replies = answer_prompts(document_corpus(spark, sf), _conversation_requests(spark, sf))
    listed, offered = (F.array_join(F.transform(c, lambda s: s["id"].cast("string")), ",") for c in ("sources", "suggestions"))
    shown = {"source_ids": listed, "suggestion_ids": offered, "reasons": F.array_join("reasons", "; ")}
    return replies.withColumns(shown).drop("sources", "suggestions")


@query("answer_several_tables", f"""{FOUND}, blocks AS (
  SELECT query_id, count(*) AS total_available, any_value(top_k) AS top_k FROM found GROUP BY query_id)
SELECT query_id, 2 * total_available AS total_available, least(2 * total_available, top_k) AS total_sources,
       CASE WHEN 2 * total_available >= 3 THEN least(2 * total_available, 10) ELSE 0 END AS offered FROM blocks""")
def answer_several_tables(spark, sf):
    """The same rows in two tables: every match counts twice, for the totals and for the rule of three."""
    rows = inputs.chunk_rows(spark, sf)
    found = present.retrieve_context({"a": rows, "b": rows}, inputs.requests(spark, sf))
    return found.groupBy("query_id").agg(
        F.first("total_available").alias("total_available"),
        F.count_if("in_context").alias("total_sources"),
        F.count_if("in_suggestions").alias("offered"),
    )


@query("validate_requests", """WITH filled AS (
  SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN '   ' ELSE text END AS query,
         CASE turn % 4 WHEN 0 THEN 4 WHEN 1 THEN 25 ELSE turn::INTEGER END AS top_k,
         CASE conv_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 ELSE 1.25 END::DOUBLE AS threshold,
         CASE conv_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 3 END AS min_suggestions FROM conversations),
judged AS (
  SELECT *, concat_ws('; ', CASE WHEN NOT regexp_matches(query, '\\S') THEN 'empty query' END,
     CASE WHEN length(query) > 1000 THEN 'query too long' END,
     CASE WHEN top_k NOT BETWEEN 1 AND 20 THEN 'top_k out of range' END,
     CASE WHEN threshold NOT BETWEEN 0 AND 1 THEN 'threshold out of range' END,
     CASE WHEN min_suggestions < 1 THEN 'min_suggestions out of range' END) AS reasons FROM filled)
SELECT conv_id, turn, top_k::INTEGER AS top_k, threshold, min_suggestions::INTEGER AS min_suggestions, reasons, reasons = '' AS valid
FROM judged""")
def validate(spark, sf):
    turn, conv = F.col("turn"), F.col("conv_id")
    asked = inputs.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(turn % 5 == 3, F.lit("   ")).otherwise(F.col("text")).alias("query"),
        F.when(turn % 4 == 1, F.lit(25)).when(turn % 4 > 1, turn.cast("int")).alias("top_k"),
        F.when(conv % 3 == 1, F.lit(0.0)).when(conv % 3 == 2, F.lit(1.25)).alias("threshold"),
        F.when(conv % 7 == 1, F.lit(0)).when(conv % 7 > 1, F.lit(3)).alias("min_suggestions"),
    )
    good, bad = validate_requests(asked)
    none = F.array().cast("array<string>")
    both = good.withColumns({"reasons": none, "valid": F.lit(True)}).unionByName(bad)
    return both.select(
        "conv_id", "turn", "top_k", "threshold", "min_suggestions",
        F.array_join("reasons", "; ").alias("reasons"), "valid",
    )
