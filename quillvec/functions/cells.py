"""Cell coercion."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillvec import constants as const


# What a run of one letter in a date format stands for.
_SHAPES = {"yyyy": r"\d{4}", "MMM": r"\p{L}+\.?"}


def _shape(fmt: str) -> str:
    """The regular expression of text that a date format can fit, with a fraction where it ends in seconds."""
    runs = re.finditer(r"'([^']*)'|([A-Za-z])\2*|([^A-Za-z'])", fmt)
    parts = []
    for run in runs:
        quoted, letter, other = run[1], run[2], run[3]
        if letter is None:
            parts.append(re.escape(quoted if quoted is not None else other))
        else:
            parts.append(_SHAPES.get(run[0], r"\d{1,2}" if len(run[0]) == 1 else r"\d{2}"))
    return "".join(parts) + (r"(?:\.\d+)?" if fmt.endswith("ss") else "")


def parse_timestamp(c: Column) -> Column:
    """Timestamp from text by the fixed format list; null when no format fits.

    A fraction behind the seconds is kept to the microsecond. Text is parsed only by formats that its characters fit, so
    prose costs one match.
    """
    shapes = {f: _shape(f) for f in const.DATE_FORMATS}
    cell = F.trim(c)

    def parsed(fmt: str) -> Column:
        if not fmt.endswith("ss"):
            return F.try_to_timestamp(cell, F.lit(fmt))
        micros = F.regexp_replace(cell, r"(\.\d{6})\d+$", "$1")
        return F.try_to_timestamp(micros, F.lit(f"{fmt}[.SSSSSS]"))

    whole = F.coalesce(*[F.when(cell.rlike(f"^{shape}$"), parsed(f)) for f, shape in shapes.items()])
    # No format fits text of other characters, or much longer text.
    return F.when((F.length(c) < 64) & cell.rlike("^(?:" + "|".join(shapes.values()) + ")$"), whole)


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_int(c: Column, source_type: str) -> Column:
    """Integer cell: floating values lose their fraction, text must be an integer."""
    if source_type in ("double", "float") or source_type.startswith("decimal"):
        return c.try_cast("int")
    return F.when(c.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c.cast("string")).try_cast("int"))


def to_decimal(c: Column, source_type: str) -> Column:
    """Decimal cell; text may carry thousands separators, a trailing sign or parentheses for a negative amount."""
    if source_type == "string":
        digits = F.regexp_replace(c, r"[,\s]", "")
        signed = F.regexp_replace(digits, r"^(?:\((.*)\)|(.*)-)$", "-$1$2")
        return signed.try_cast("decimal(18,2)")
    return c.try_cast("decimal(18,2)")


def to_timestamp(c: Column, source_type: str) -> Column:
    if source_type in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp")
    return parse_timestamp(c.cast("string"))


def coerce(c: Column, source_type: str, target: str) -> Column:
    if target == "string":
        return c.cast("string")
    if target == "int":
        return to_int(c, source_type)
    if target.startswith("decimal"):
        return to_decimal(c, source_type)
    if target == "timestamp":
        return to_timestamp(c, source_type)
    if target == "double":
        return to_double(c)
    raise ValueError(f"no coercion to {target}")
