"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every window of consecutive k-grams. Two texts that share WINDOW words in
a row share a window of k-grams, hence its smallest hash, so no shared span is missed. Documents that share a kept hash
with an item are suspects. Windows of theirs whose smallest hash and whose hash of all WINDOW words are an item's give
alignments, and each is extended word by word to the exact spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import OWN_KEY, PLAIN_WORD_GAP, ascii_lower, documents, with_own_key, words
from quillvec.llm.near_dup import BROADCAST_IDS, chosen
from quillvec.session import settle

# Words in a row that count as a leak.
WINDOW = 10
# KGRAM + GUARD - 1 = WINDOW: the guarantee of winnowing.
KGRAM = 5
GUARD = WINDOW - KGRAM + 1


def merged(array: str, other: str, shift: int, merge) -> Column:
    """Merge every element with the one `shift` places behind it in `other`; the last `shift` are of no use."""
    return F.zip_with(F.col(array), F.slice(F.col(other), F.lit(shift + 1), F.size(other)), merge)


def whole_ones(array: str, of: str, k: int) -> Column:
    """Without the last k - 1 elements, which reach beyond the end of `of`."""
    return F.slice(F.col(array), F.lit(1), F.greatest(F.size(of) - (k - 1), F.lit(0)))


def add_grams(df: DataFrame, hashes: str, k: int, out: str) -> DataFrame:
    """Add the hashes of the k-grams of a column of word hashes, put together from shorter ones."""
    mix = lambda a, b: F.xxhash64(a, b)
    df, size = df.withColumn(out, F.transform(hashes, lambda a: F.xxhash64(a, F.lit(k)))), 1
    for bit in bin(k)[3:]:
        df, size = df.withColumn(out, merged(out, out, size, mix)), 2 * size
        if bit == "1":
            df, size = df.withColumn(out, merged(out, hashes, size, mix)), size + 1
    return df.withColumn(out, whole_ones(out, hashes, k))


def add_minima(df: DataFrame, kgrams: str, out: str) -> DataFrame:
    """Add the smallest hash of each window of GUARD k-grams, put together from shorter windows."""
    df, size = df.withColumn(out, F.col(kgrams)), 1
    while size < GUARD:
        step = min(size, GUARD - size)
        df, size = df.withColumn(out, merged(out, out, step, lambda a, b: F.least(a, b))), size + step
    return df.withColumn(out, whole_ones(out, kgrams, GUARD))


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """Add `_words`, their hashes, all k-grams and the window minima."""
    hashed = df.withColumn("_words", words(ascii_lower(F.col(text)), PLAIN_WORD_GAP)).withColumn(
        "_hashes", F.transform("_words", lambda w: F.xxhash64(w))
    )
    return add_minima(add_grams(hashed, "_hashes", KGRAM, "_grams"), "_grams", "_minima")


def windows(df: DataFrame) -> DataFrame:
    """Add `_windows`: (place, fp, whole) of every window of WINDOW words, its smallest k-gram hash and the hash of all."""
    return add_grams(df, "_hashes", WINDOW, "_whole").withColumn(
        "_windows",
        F.transform(
            F.arrays_zip("_minima", "_whole"),
            lambda x, i: F.struct(i.alias("place"), x["_minima"].alias("fp"), x["_whole"].alias("whole")),
        ),
    )


def short_windows(k: int) -> Column:
    return F.transform(f"_short{k}", lambda x, i: F.struct(i.alias("place"), x.alias("fp"), x.alias("whole")))


def item_table(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct items with words: item, _words, span (the window in words)."""
    plain = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("_text")).distinct()
    return (
        with_grams(plain, "_text").where(F.size("_words") > 0)
        .withColumn("span", F.least(F.size("_words"), F.lit(WINDOW)))
        .withColumn("entry", F.xxhash64("item", "_text"))
    )


# The items' words are broadcast up to so many characters.
ITEM_BYTES = 32_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For every row of `docs`: doc_id, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated.

    A-Z are lower-cased; a word is a run of ASCII letters and digits or of anything beyond ASCII. A window is WINDOW
    consecutive words of an item, or the whole of a shorter one. Items without id or words are left out; rows that
    repeat an id count as one item with the windows of all. A null or empty document has no words and no hits; a row
    that is repeated is returned as often. An empty benchmark leaves all rows without hits.
    """
    table = settle(item_table(items, item_id, item_text).drop("_text"), "items")
    lengths = sorted(r["span"] for r in table.where(F.col("span") < WINDOW).select("span").distinct().collect())
    # At most WINDOW - 1 of them.
    prints = windows(table.where(F.col("span") == WINDOW)).select("entry", "span", F.explode("_windows").alias("s"))
    for k in lengths:
        whole = add_grams(table.where(F.col("span") == k), "_hashes", k, f"_short{k}")
        prints = prints.union(whole.select("entry", "span", F.explode(short_windows(k)).alias("s")))
    prints = settle(prints.select("entry", "span", F.col("s.place").alias("item_place"), "s.fp", "s.whole"), "prints")
    known = settle(prints.select("fp").distinct(), "fps")
    n_known, n_prints = known.count(), prints.count()
    n_items, n_bytes = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.array_join("_words", " "))), F.lit(0))).first()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    grammed = with_grams(rows, "text")
    tried = F.col("_minima")
    if lengths:
        for k in lengths:
            grammed = add_grams(grammed, "_hashes", k, f"_short{k}")
        tried = F.concat(tried, *[F.col(f"_short{k}") for k in lengths])
    # The columns are made before the rows are multiplied, so that no row carries its text.
    narrow = grammed.select(
        "doc_id",
        F.md5(F.coalesce("text", F.lit(""))).alias("copy"),
        F.size("_words").cast("long").alias("n_words"),
        F.array_distinct(tried).alias("_fps"),
    )
    flat = narrow.select("doc_id", "copy", "n_words", F.posexplode_outer("_fps").alias("at", "fp"))
    marked = flat.join(small(known.withColumn("hit", F.lit(1)), n_known), "fp", "left")
    per_row = settle(
        marked.groupBy("doc_id", "copy", "n_words").agg(
            F.sum((F.coalesce("at", F.lit(0)) == 0).cast("long")).alias("times"), F.count("hit").alias("shared")
        ),
        "screened",
    )
    # From here on, equal texts are read once.
    suspects = settle(per_row.where("shared > 0").select("copy").distinct(), "suspects")
    texts = rows.select(F.md5(F.coalesce("text", F.lit(""))).alias("copy"), "text")
    read = settle(with_grams(chosen(texts, suspects, "copy").dropDuplicates(["copy"]), "text").drop("text"), "read")

    places = windows(read).select("copy", F.explode("_windows").alias("s"), F.lit(WINDOW).alias("span"))
    for k in lengths:
        short = add_grams(read, "_hashes", k, f"_short{k}")
        places = places.union(short.select("copy", F.explode(short_windows(k)).alias("s"), F.lit(k).alias("span")))
    places = places.select("copy", "span", "s.place", "s.fp", "s.whole")
    aligned = (
        places.join(small(prints, n_prints), ["whole", "fp", "span"])
        .select("copy", "entry", "span", (F.col("place") - F.col("item_place")).alias("shift"))
        .distinct()
    )
    length = table.select("entry", "item", F.size("_words").alias("n"))
    aligned = settle(aligned.join(small(length, n_items), "entry"), "aligned")
    # The part of the document beside the item, cut where the document is joined.
    low = F.greatest(-F.col("shift"), F.lit(0))
    alongside = (
        aligned.join(read.select("copy", "_words"), "copy")
        .select(
            "copy", "entry", "item", "span", "shift",
            low.alias("low"),
            F.slice("_words", F.col("shift") + low + 1, F.least(F.col("n"), F.size("_words") - F.col("shift")) - low).alias("here"),
        )
    )
    there = table.select("entry", F.col("_words").alias("_item_words"))
    paired = alongside.join(F.broadcast(there) if n_bytes <= ITEM_BYTES else there, "entry").withColumn(
        "there", F.slice("_item_words", F.col("low") + 1, F.size("here"))
    ).drop("_item_words")
    starts = F.when(
        F.size("here") >= F.col("span"),
        F.filter(
            F.sequence(F.lit(0), F.greatest(F.size("here") - F.col("span"), F.lit(0))),
            lambda s: F.slice(F.col("here"), s + 1, F.col("span")) == F.slice(F.col("there"), s + 1, F.col("span")),
        ),
    )
    spans = paired.withColumn("starts", starts).where(F.size("starts") > 0)
    found = settle(
        spans.select(
            "copy", "item",
            F.array_distinct(F.flatten(F.transform(
                "starts", lambda s: F.sequence(s + F.col("low") + F.col("shift"), s + F.col("low") + F.col("shift") + F.col("span") - 1)
            ))).alias("hit_words"),
        ),
        "spans",
    )
    hits = found.select("copy", F.explode("hit_words").alias("w")).distinct().groupBy("copy").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("copy", "item").distinct().groupBy("copy").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit_rows = hits.join(named, "copy")
    # Repeated rows come back as often as they were read.
    out = per_row.join(hit_rows, "copy", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "items",
    )


def query(spark, sf: str) -> DataFrame:
    return contamination(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")).drop("items")


def stage(spark, docs: DataFrame, sf: str) -> DataFrame:
    """Documents without those that hold a benchmark window.

    Rows that share a doc_id with such a document go too; a row without doc_id is judged by its own text. Repeated rows
    are kept or dropped together, an empty table stays empty, and other columns, whatever their names, come back as
    they are.
    """
    keyed = with_own_key(docs)
    seen = contamination(keyed.select(OWN_KEY, "text"), spark.read.parquet(f"{sf}/benchmark.parquet"), OWN_KEY)
    leaked = settle(seen.where("contaminated").select(F.col("doc_id").alias(OWN_KEY)).distinct(), "leaked")
    return chosen(keyed, leaked, OWN_KEY, "left_anti").select(*docs.columns)


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
spans AS (SELECT item_id, w, least(len(w), {WINDOW}) AS span FROM b WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT item_id, span, array_to_string(w[s : s + span - 1], ' ') AS gram
  FROM (SELECT item_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM spans)),
lengths AS (SELECT DISTINCT span FROM wanted),
seen AS (
  SELECT doc_id, s, span, array_to_string(w[s : s + span - 1], ' ') AS gram
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM d CROSS JOIN lengths)),
hit AS (SELECT doc_id, s, span, item_id FROM seen JOIN wanted USING (span, gram)),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + span)) AS p FROM (SELECT DISTINCT doc_id, s, span FROM hit)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""
