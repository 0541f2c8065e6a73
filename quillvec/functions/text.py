"""Text column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillvec import constants as const
from quillvec.functions.vector import bind


def not_blank(c: Column) -> Column:
    """True when the text holds a character other than white space; false for null."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def file_name_of(path: Column) -> Column:
    """Last path component, `unknown` when there is none."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(const.UNKNOWN_FILE))


def table_name_from_file(path: Column, prefix: str | None = None) -> Column:
    """File stem with blanks and dashes as underscores, after an optional prefix."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    name = F.translate(stem, " -", "__")
    return F.concat_ws("_", F.lit(prefix), name) if prefix else name


def preview(c: Column, chars: int) -> Column:
    cut = F.concat(F.substring(c, 1, chars), F.lit("..."))
    return F.when(F.char_length(c) > chars, cut).otherwise(c)


def combined_text(columns: Sequence[str]) -> Column:
    """`name: value | name: value` over the given columns; null and blank cells are left out."""

    def part(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        return F.when(not_blank(value), F.concat(F.lit(f"{name}: "), strip(value)))

    return F.concat_ws(" | ", *[part(name) for name in columns]) if columns else F.lit("")


def full_text_context(name: Column, category: Column, description: Column, price: Column) -> Column:
    labelled = [("Product: ", name), ("Category: ", category), ("Description: ", description)]
    parts = [F.when(not_blank(value), F.concat(F.lit(label), value)) for label, value in labelled]
    # The sign of a negative amount goes before the currency mark.
    amount = F.concat(F.when(price < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(price), 2))
    parts.append(F.when(price.isNotNull(), F.concat(F.lit("Price: "), amount)))
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def chunk_fixed(text: Column, size: int = const.CHUNK_SIZE, overlap: int = const.CHUNK_OVERLAP) -> Column:
    """Sliding windows of `size` code points that share `overlap` with the next one.

    The text is cut once into steps of `size - overlap`, and every chunk borrows its tail from the next
    steps, so the work stays linear in the text length.
    """
    step = size - overlap
    if step <= 0 or overlap < 0:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    if overlap > step:
        starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - overlap - 1, F.lit(0)), F.lit(step))
        windows = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))
        return F.when(F.char_length(text) > 0, windows).otherwise(F.array().cast("array<string>"))

    def windows_of(blocks: Column) -> Column:
        def window(block: Column, i: Column) -> Column:
            borrowed = F.coalesce(F.substring(F.get(blocks, i + 1), 1, overlap), F.lit(""))
            return F.concat(block, borrowed)

        # A last step no longer than the overlap is already inside the chunk before it.
        spare = (F.size(blocks) > 1) & (F.char_length(F.element_at(blocks, -1)) <= overlap)
        kept = F.size(blocks) - F.when(spare, 1).otherwise(0)
        return F.slice(F.transform(blocks, window), F.lit(1), kept)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return bind(blocks, lambda b: F.when(F.size(b) > 0, windows_of(b)).otherwise(b))
