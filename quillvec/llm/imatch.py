"""I-Match document fingerprints.

A lexicon keeps the terms whose document share lies in a band (a band of inverse document frequency). A document's
distinct lexicon terms are sorted and hashed as a whole, and again as far as they lie in each of several random subsets
of the lexicon. Subsets are drawn independently and overlap; they hold from a half of the lexicon down to 2^-RATES of
it, so that an edit changes the hashes of large subsets and leaves those of small ones, whatever the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import PLAIN_WORD_GAP, ascii_lower, documents, running, words
from quillvec.session import settle

# Terms are numbered by hash. The table of lexicon terms is one bit per number, 128 KB whatever the corpus holds.
TERM_BITS = 20
# Share of documents a lexicon term is in; it must also be in two documents.
LEAST_SHARE, MOST_SHARE = 0.001, 0.1
# Independent draws of subsets. The subset of rate j of a draw holds each lexicon term with chance 2^-j.
DRAWS = 5
RATES = 15


def term_ids(text: Column) -> Column:
    """Distinct term numbers of a text."""
    terms = F.array_distinct(words(ascii_lower(text), PLAIN_WORD_GAP))
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t).bitwiseAND(2**TERM_BITS - 1).cast("int")))


def lexicon(ids: DataFrame, rows: int) -> Column:
    """The band's terms as an array of 64-bit words, from a frame of `id` with a row per document and term.

    The counts are taken over all documents; what the driver gets is 2^TERM_BITS bits at most.
    """
    shares = ids.groupBy("id").agg(F.count(F.lit(1)).alias("df"))
    band = shares.where((F.col("df") >= max(2, LEAST_SHARE * rows)) & (F.col("df") <= max(2, MOST_SHARE * rows)))
    packed = band.groupBy(F.shiftright("id", 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63))).alias("bits")
    )
    table = [0] * (2**TERM_BITS // 64)
    for row in packed.collect():
        table[row["at"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def kept_terms(text: Column, ids: Column, table: Column) -> Column:
    """Sorted lexicon terms of a text; all its terms where none is in the band, the text's own number where it has none."""
    band = F.filter(
        ids, lambda t: F.call_function("getbit", F.get(table, F.shiftright(t, 6)), t.bitwiseAND(63)) == 1
    )
    return F.sort_array(
        F.when(F.size(band) > 0, band)
        .when(F.size(ids) > 0, ids)
        .otherwise(F.array(F.xxhash64(text).bitwiseAND(2**TERM_BITS - 1).cast("int")))
    )


def subset_hashes(terms: Column) -> Column:
    """For each draw, the hashes of 32 bits of the terms in its subsets of rate 1 to RATES, 0 where there is none."""

    def one(draw: Column) -> Column:
        def inside(left: Column, rate: Column) -> Column:
            low = F.call_function("shiftleft", F.lit(1).cast("long"), rate) - 1
            return F.filter(left, lambda t: F.xxhash64(t, draw).bitwiseAND(low) == 0)

        def step(state: Column, rate: Column) -> Column:
            left = state["left"]
            hashed = F.when(F.size(left) > 0, F.shiftright(F.xxhash64(left), 32).cast("int")).otherwise(0)
            return F.struct(inside(left, rate + 1).alias("left"), F.concat(state["out"], F.array(hashed)).alias("out"))

        start = F.struct(inside(terms, F.lit(1)).alias("left"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(RATES)), start, step, lambda state: state["out"])

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), one))


def with_fingerprint(df: DataFrame, text: str, out: str, table: Column) -> DataFrame:
    """Add the fingerprint of `text` as `out`: the hash of all its lexicon terms, and those of the random subsets."""
    return (
        df.withColumn("_ids", term_ids(F.col(text)))
        .withColumn("_kept", kept_terms(F.col(text), F.col("_ids"), table))
        .withColumn(out, F.struct(F.xxhash64("_kept").alias("whole"), subset_hashes(F.col("_kept")).alias("subsets")))
        .drop("_ids", "_kept")
    )


def as_string(print_: Column) -> Column:
    """The fingerprint as text: the whole hash, then those of the subsets in hexadecimal, empty subsets left blank."""
    low = F.lit(0xFFFFFFFF)
    hexed = F.transform(print_["subsets"], lambda h: F.when(h == 0, "").otherwise(F.hex(h.cast("long").bitwiseAND(low))))
    return F.concat(F.hex(print_["whole"]), F.lit(":"), F.array_join(hexed, "."))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common terms among the terms of both: 1 for equal prints, else 1 - 2^-m.

    m is the number of equal hashes of filled subsets, per draw. Of u terms of which c are in one text only, a subset of
    rate r is filled and alike with chance (1-r)^c - (1-r)^u; over halving rates that adds up to log2(u/c).
    """
    same = F.size(F.filter(F.arrays_zip(a["subsets"].alias("x"), b["subsets"].alias("y")), lambda p: (p["x"] == p["y"]) & (p["x"] != 0)))
    return F.when((a["whole"] == b["whole"]) & (a["subsets"] == b["subsets"]), 1.0).otherwise(1 - F.pow(F.lit(2.0), -same / DRAWS))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and `fingerprint` (a struct; see `as_string`, `likeness`) of every row of `df`.

    Terms are runs of ASCII letters and digits or anything beyond ASCII, A-Z lower-cased. A null text counts as empty;
    equal texts have equal fingerprints; a text without lexicon terms is hashed by all its terms, one without any term
    by itself. Repeated rows are kept. An empty table gives no rows. Other columns are ignored.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_fingerprint(docs, "text", "fingerprint", corpus_lexicon(docs))


def corpus_lexicon(docs: DataFrame) -> Column:
    ids = docs.select(F.explode(term_ids(F.col("text"))).alias("id"))
    return lexicon(ids, docs.count())


def followed(docs: DataFrame) -> DataFrame:
    """Each distinct row (doc_id, text) with `times` and the start of the next one's text, by descending doc_id.

    The last is followed by the first. `head` has as many code points as a third of the row's own text, or all.
    Returns key, next_key, times, text, head; keys are of (doc_id, text).
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    narrow = docs.select(key.alias("key"), F.length("text").alias("n")).groupBy("key").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("times")
    )
    placed = settle(running(narrow, ["key"], [], "order"), "order")
    rows = placed.count()
    ask = placed.select("key", "times", F.floor(F.col("n") / 3).cast("int").alias("take"), F.pmod(F.col("row_index") - 1, F.lit(max(rows, 1))).alias("at"))
    ask = ask.join(placed.select(F.col("key").alias("next_key"), F.col("row_index").alias("at")), "at")
    texts = docs.select(key.alias("key"), "text")
    once = texts.dropDuplicates(["key"]) if placed.where("times > 1").limit(1).count() else texts
    heads = (
        ask.select("next_key", F.col("key").alias("asker"), "take").join(once.withColumnRenamed("key", "next_key"), "next_key")
        .select("asker", F.substring("text", F.lit(1), F.col("take")).alias("head"))
    )
    sized = ask.select(F.col("key").alias("asker"), "next_key", "times")
    whole = once.join(sized, once["key"] == sized["asker"]).drop("asker")
    return whole.join(heads, whole["key"] == heads["asker"]).drop("asker")


def query(spark, sf: str) -> DataFrame:
    """Every document, its edited text, and how alike their fingerprints and the next document's are."""
    docs = documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = corpus_lexicon(docs)
    n = F.length("text")
    edited = followed(docs).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int")), "head")
    ).drop("head")
    printed = with_fingerprint(with_fingerprint(edited, "text", "print", table), "edited", "edited_print", table)
    done = settle(
        printed.select(
            "key", "next_key", "times", F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "print", "edited_print",
        ),
        "prints",
    )
    after = done.select(F.col("key").alias("next_key"), F.col("print").alias("next_print"))
    return done.join(after, "next_key").withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(
        F.col("key.doc_id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_string(F.col("print")).alias("fingerprint"),
        as_string(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
