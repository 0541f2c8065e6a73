"""Request texts to ranked sources and prompts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.operators.clean import validate_requests
from quillvec.operators.present import (
    CHUNK_PAYLOAD,
    assemble_context,
    chat_suggestions,
    default_fields,
    render_prompt,
    retrieve_context,
    sources,
)
from quillvec.operators.search import retrieve_selected
from quillvec.plans.load import hashed
from quillvec.session import settle


def encode_requests(requests: DataFrame, encode: Callable[[Column], Column] | None = None) -> DataFrame:
    encode = encode or hashed()
    return requests.withColumn("query_vec", encode(F.col("query")))


def answer_prompts(
    corpus: DataFrame | dict[str, DataFrame], requests: DataFrame, encode: Callable[[Column], Column] | None = None, **defaults
) -> DataFrame:
    """Request texts to one row per request: prompt, sources, suggestion block, or why it was rejected.

    Requests that chose ids are answered from those rows, the others from their best rows; a dict of corpora
    is searched as one. `total_available` counts the matches of the others, in all corpora; where there are at least
    three and the request wants them, `suggestions` lists the first ten and `message` says so. A rejected request has
    no prompt and its reasons; `reasons` is empty for the others.
    """
    valid, rejected = validate_requests(requests, **defaults)
    # Sizing, scoring and joining each read the requests: encode them once.
    asked = settle(encode_requests(valid, encode), "requests")
    wanted = ["query_id", "rank", "id", "similarity", *CHUNK_PAYLOAD]
    chose = F.coalesce(F.size("selected_ids"), F.lit(0)) > 0 if "selected_ids" in asked.columns else F.lit(False)
    free = asked.filter(~chose)
    # At most ten rows, or top_k, of a request; read for the answer and for the suggestions.
    retrieved = settle(retrieve_context(corpus, free), "retrieved")
    rows = retrieved.filter("in_context").select(*wanted)
    if "selected_ids" in asked.columns:
        rows = rows.unionByName(_chosen_rows(corpus, asked.filter(chose), wanted))
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", "file_name", "page_number", "content_preview", "similarity")))
    shown = sources(rows).groupBy("query_id").agg(listed.alias("sources"))
    totals = retrieved.groupBy("query_id").agg(F.first("total_available").alias("total_available"))
    block = chat_suggestions(retrieved).drop("total_available")
    prompts = render_prompt(assemble_context(rows), asked).join(shown, "query_id", "left")
    prompts = prompts.join(totals, "query_id", "left").join(block, "query_id", "left")
    none = F.array().cast("array<string>")
    answered = prompts.withColumns({"sources": F.coalesce("sources", F.array().cast(shown.schema["sources"].dataType)), "reasons": none})
    return answered.unionByName(rejected.select("query_id", "reasons"), allowMissingColumns=True)


def _chosen_rows(corpus: DataFrame | dict[str, DataFrame], asked: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the ids a request chose. Of several corpora each is asked; ranks go on by corpus name, then by rank."""
    if not isinstance(corpus, dict):
        return default_fields(retrieve_selected(corpus, asked, CHUNK_PAYLOAD)).select(*wanted)
    parts = [
        default_fields(retrieve_selected(corpus[name], asked, CHUNK_PAYLOAD)).select(*wanted).withColumn("_part", F.lit(i))
        for i, name in enumerate(sorted(corpus))
    ]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    # A request holds no more rows than it chose ids.
    order = Window.partitionBy("query_id").orderBy("_part", "rank")
    return rows.withColumn("rank", F.row_number().over(order)).select(*wanted)
