"""Shaping ranked rows for a reader: suggestions, sources, context and prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec import constants as const
from quillvec.functions.text import preview
from quillvec.operators.search import default_requests, retrieve_multi_table, search_batch

CHUNK_PAYLOAD = ["content", "file_name", "page_number", "chunk_index"]


def default_fields(rows: DataFrame) -> DataFrame:
    """Null content, file, page and chunk numbers get their stand-ins."""
    blanks = {
        "content": F.lit(""),
        "file_name": F.lit(const.UNKNOWN_FILE),
        "page_number": F.lit(0),
        "chunk_index": F.lit(0),
    }
    return rows.withColumns({n: F.coalesce(F.col(n), blank) for n, blank in blanks.items() if n in rows.columns})


def keyword_match(rows: DataFrame, keyword: str, limit: int, content: str = "content", key: str = "id") -> DataFrame:
    """The first `limit` rows by id whose content holds the keyword, in any case."""
    # The keyword is matched literally: LIKE wildcards in it are escaped.
    escaped = keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return rows.filter(F.col(content).ilike(f"%{escaped}%")).orderBy(key).limit(limit)


def similarity_4dp(similarity: Column) -> Column:
    return F.round(similarity, 4)


def similarity_percent(similarity: Column) -> Column:
    return F.round(similarity * 100, 2)


def shown_page(page: Column) -> Column:
    """Pages are stored from 0 and shown from 1."""
    return page + 1


def similarity_band(similarity: Column) -> Column:
    return (
        F.when(similarity > const.HIGH_SIMILARITY, "high")
        .when(similarity >= const.MEDIUM_SIMILARITY, "medium")
        .otherwise("low")
    )


def format_scores(ranked: DataFrame) -> DataFrame:
    """1-based index and page, similarity with 4 and percent with 2 decimals."""
    return ranked.select(
        "query_id",
        F.col("rank").alias("index"),
        "id",
        shown_page(F.col("page_number")).alias("page_number"),
        similarity_4dp(F.col("similarity")).alias("similarity"),
        similarity_percent(F.col("similarity")).alias("similarity_percent"),
    )


def _message(template: str, n: Column) -> Column:
    head, tail = template.split("{n}")
    return F.concat(F.lit(head), n.cast("string"), F.lit(tail))


def suggest(corpus: DataFrame, requests: DataFrame, **options) -> DataFrame:
    """Numbered suggestions per request."""
    asked = default_requests(requests, const.SUGGEST_TOP_K, const.SUGGEST_THRESHOLD)
    found = default_fields(search_batch(corpus, asked, CHUNK_PAYLOAD, **options))
    return found.select(
        "query_id",
        F.col("rank").alias("index"),
        "id",
        "content",
        preview(F.col("content"), const.SUGGESTION_PREVIEW_CHARS).alias("content_preview"),
        "file_name",
        shown_page(F.col("page_number")).alias("page_number"),
        similarity_4dp(F.col("similarity")).alias("similarity"),
        similarity_percent(F.col("similarity")).alias("similarity_percent"),
    )


def suggestion_replies(
    suggestions: DataFrame, requests: DataFrame, min_suggestions: int = const.MIN_SUGGESTIONS
) -> DataFrame:
    """One row per request: the nested suggestion list (at most top_k items), its length, flag and message."""
    fields = [c for c in suggestions.columns if c != "query_id"]
    nested = suggestions.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("suggestions"))
    replies = requests.select("query_id").join(nested, "query_id", "left")
    found = F.coalesce(F.size("suggestions"), F.lit(0))
    return replies.select(
        "query_id",
        "suggestions",
        found.alias("total_found"),
        (found >= min_suggestions).alias("has_multiple"),
        F.when(found > 0, _message(const.FOUND_MESSAGE, found)).otherwise(const.NOT_FOUND_MESSAGE).alias("message"),
    )


def retrieve_context(corpus: DataFrame | dict[str, DataFrame], requests: DataFrame, **options) -> DataFrame:
    """Chat retrieval: rows for the answer and the suggestion block, marked per row. A dict of corpora is searched as one.

    `in_context` marks the first top_k rows. `in_suggestions` marks the first ten when the request has at
    least three matches, wants suggestions and chose no ids. `total_available` counts all matches.
    """
    asked = default_requests(requests, const.CHAT_TOP_K, const.CHAT_THRESHOLD)
    wants = F.coalesce(F.col("return_suggestions"), F.lit(True)) if "return_suggestions" in asked.columns else F.lit(True)
    if "selected_ids" in asked.columns:
        wants = wants & (F.coalesce(F.size("selected_ids"), F.lit(0)) <= 0)
    asked = asked.withColumns({"context_k": F.col("top_k"), "wants_suggestions": wants})
    widened = asked.withColumn("top_k", F.greatest(F.col("top_k"), F.lit(const.CHAT_SUGGESTION_LIMIT)))
    search = retrieve_multi_table if isinstance(corpus, dict) else search_batch
    found = default_fields(search(corpus, widened, CHUNK_PAYLOAD, totals=True, **options))
    marked = found.join(asked.select("query_id", "context_k", "wants_suggestions"), "query_id")
    block = (
        F.col("wants_suggestions")
        & (F.col("total") >= const.CHAT_SUGGESTION_MIN_MATCHES)
        & (F.col("rank") <= const.CHAT_SUGGESTION_LIMIT)
    )
    return (
        marked.withColumns({"in_context": F.col("rank") <= F.col("context_k"), "in_suggestions": block})
        .filter(F.col("in_context") | F.col("in_suggestions"))
        .select(
            "query_id",
            "id",
            "rank",
            "similarity",
            F.col("total").alias("total_available"),
            "in_context",
            "in_suggestions",
            *CHUNK_PAYLOAD,
        )
    )


def chat_suggestions(retrieved: DataFrame) -> DataFrame:
    """Suggestion block of chat retrieval, one row per request that gets one."""
    item = F.struct(
        F.col("rank").alias("index"),
        "id",
        preview(F.col("content"), const.SOURCE_PREVIEW_CHARS).alias("content_preview"),
        "file_name",
        shown_page(F.col("page_number")).alias("page_number"),
        similarity_4dp(F.col("similarity")).alias("similarity"),
        similarity_percent(F.col("similarity")).alias("similarity_percent"),
    )
    return (
        retrieved.filter("in_suggestions")
        .groupBy("query_id")
        .agg(F.first("total_available").alias("total_available"), F.sort_array(F.collect_list(item)).alias("suggestions"))
        .withColumn("message", _message(const.CHAT_SUGGESTION_MESSAGE, F.col("total_available")))
    )


def sources(ranked: DataFrame) -> DataFrame:
    """Source list of an answer: file, shown page, preview and rounded similarity."""
    return ranked.select(
        "query_id",
        "rank",
        "id",
        "file_name",
        shown_page(F.col("page_number")).alias("page_number"),
        preview(F.col("content"), const.SOURCE_PREVIEW_CHARS).alias("content_preview"),
        similarity_4dp(F.col("similarity")).alias("similarity"),
    )


def dedupe_sources(ranked: DataFrame) -> DataFrame:
    """The best-ranked source of each (request, file, page)."""
    same_page = Window.partitionBy("query_id", "file_name", "page_number").orderBy("rank")
    first = ranked.withColumn("_n", F.row_number().over(same_page)).filter("_n = 1").drop("_n")
    return sources(first)


def context_line(file_name: Column, page_number: Column, content: Column) -> Column:
    opening, rest = const.CONTEXT_LINE.split("{file}")
    middle, rest = rest.split("{page}")
    closing, ending = rest.split("{content}")
    return F.concat(
        F.lit(opening), file_name, F.lit(middle), shown_page(page_number).cast("string"), F.lit(closing), content,
        F.lit(ending),
    )


def assemble_context(ranked: DataFrame) -> DataFrame:
    """One context text per request: its lines in rank order, a blank line between them.

    A request holds at most its top_k (or chosen) rows, so the list stays small.
    """
    line = context_line(F.col("file_name"), F.col("page_number"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return ranked.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("context"),
        F.count("*").alias("total_sources"),
    )


def render_prompt(contexts: DataFrame, requests: DataFrame, question: str = "query") -> DataFrame:
    """The filled prompt per request; requests without context get the fixed answer and a flag instead."""
    before, rest = const.PROMPT_TEMPLATE.split("{context}")
    between, after = rest.split("{question}")
    joined = requests.select("query_id", F.col(question).alias("_question")).join(contexts, "query_id", "left")
    empty = F.col("context").isNull()
    prompt = F.concat(F.lit(before), F.col("context"), F.lit(between), F.col("_question"), F.lit(after))
    return joined.select(
        "query_id",
        F.when(~empty, prompt).alias("prompt"),
        F.coalesce("total_sources", F.lit(0)).cast("long").alias("total_sources"),
        empty.alias("no_results"),
        F.when(empty, F.lit(const.NO_ANSWER_MESSAGE)).alias("answer"),
    )
