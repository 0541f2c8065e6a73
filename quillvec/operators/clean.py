"""Sheet cleaning, column roles and request checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, BooleanType, StringType, DateType, TimestampNTZType, TimestampType

from quillvec import constants as const
from quillvec.functions import cells
from quillvec.functions.text import not_blank


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def drop_empty_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="all", subset=list(subset) if subset else None)


def min_cells(columns: int) -> int:
    """Cells a sheet row must have: three, or a tenth of the columns."""
    return max(const.MIN_ROW_CELLS, int(columns * const.DENSITY))


def drop_sparse_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    names = list(subset or df.columns)
    return df.na.drop(thresh=min_cells(len(names)), subset=names)


def filled_columns(df: DataFrame, subset: Sequence[str] | None = None) -> list[str]:
    """Columns with at least one value, found in one aggregation pass."""
    names = list(subset or df.columns)
    counts = df.agg(*[F.max(_named(n).isNotNull()).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if counts[i]]


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Remove columns without any value; `keep` names provenance columns that always stay."""
    filled = set(filled_columns(df, [c for c in df.columns if c not in keep]))
    return df.select(*[_named(c) for c in df.columns if c in filled or c in keep])


def _header(position: int, name: str | None) -> str:
    shown = str(name or "")
    return f"Column_{position}" if shown.lower() in ("", "nan") or shown.lower().startswith("unnamed") else shown


def normalized_names(names: Sequence[str | None]) -> list[str]:
    """Unique column names, compared without case as Spark does.

    Blank, `unnamed*` and `nan` headers become `Column_{i}`. The first of equal names keeps it; each later one takes
    the first `_2`, `_3` ... that no header and no earlier column has.
    """
    wanted = [_header(i, name) for i, name in enumerate(names)]
    taken = {name.lower(): i for i, name in reversed(list(enumerate(wanted)))}
    out = []
    for i, name in enumerate(wanted):
        if taken[name.lower()] != i:
            name = next(f"{name}_{n}" for n in count(2) if f"{name}_{n}".lower() not in taken)
            taken[name.lower()] = i
        out.append(name)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


@dataclass
class Roles:
    text: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)

    @property
    def data(self) -> list[str]:
        return self.text + self.numeric + self.datetime


def text_role_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Role of each text column, judged by all its values in one aggregation: mostly dates, prose, or ignored.

    Columns without a value are left out.
    """
    def judged(i: int, value: Column) -> list[Column]:
        return [
            F.count(value).alias(f"n{i}"),
            F.count_if(cells.parse_timestamp(value).isNotNull()).alias(f"d{i}"),
            F.bool_or((F.char_length(value) > 5) & value.rlike(r"\p{L}")).alias(f"p{i}"),
        ]

    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, judged long, dates long, prose boolean, role string")
    row = df.agg(*[c for i, n in enumerate(names) for c in judged(i, _named(n))])
    columns = F.array(*[
        F.struct(
            F.lit(n).alias("column_name"), F.col(f"n{i}").alias("judged"), F.col(f"d{i}").alias("dates"),
            F.col(f"p{i}").alias("prose"),
        )
        for i, n in enumerate(names)
    ])
    role = F.when(F.col("dates") > F.col("judged") * 0.5, "datetime").when(F.col("prose"), "text").otherwise("ignored")
    return row.select(F.inline(columns)).where("judged > 0").withColumn("role", role)


def _typed_role(name: str, kind) -> str | None:
    """Role decided by name and type alone; None for text columns that need a look at their values."""
    if name.lower() in const.IGNORED_COLUMN_NAMES:
        return "ignored"
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return "datetime"
    if isinstance(kind, (NumericType, BooleanType)):
        return "numeric"
    return None if isinstance(kind, StringType) else "ignored"


def infer_column_roles(df: DataFrame, order: str = "row_index", skip: Sequence[str] = (), keep_short: bool = False) -> Roles:
    """Text, numeric, datetime and ignored columns, in column order.

    `keep_short` turns text columns that would be ignored for their short values into text columns.
    """
    fields = [f for f in df.schema.fields if f.name != order and f.name not in skip]
    roles = {f.name: _typed_role(f.name, f.dataType) for f in fields}
    open_names = [name for name, role in roles.items() if role is None]
    if open_names:
        # At most one row per column comes back.
        found = {r["column_name"]: r["role"] for r in text_role_table(df, open_names).collect()}
        for name in open_names:
            role = found.get(name, "ignored")
            roles[name] = "text" if role == "ignored" and keep_short and name in found else role
    out = Roles()
    for name, role in roles.items():
        getattr(out, role).append(name)
    return out


def coerce_by_role(df: DataFrame, roles: Roles, keep: Sequence[str] = ()) -> DataFrame:
    """Text to string, numeric to double, datetime to timestamp; what does not convert becomes null."""
    kinds = dict(df.dtypes)
    targets = {**dict.fromkeys(roles.text, "string"), **dict.fromkeys(roles.numeric, "double"),
               **dict.fromkeys(roles.datetime, "timestamp")}
    typed = [cells.coerce(_named(n), kinds[n], targets[n]).alias(n) for n in roles.data]
    return df.select(*[_named(n) for n in keep], *typed)


def drop_low_density(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows with a tenth of the given columns filled, at least one."""
    needed = max(1, int(len(columns) * const.DENSITY))
    return df.na.drop(thresh=needed, subset=list(columns)) if columns else df.filter(F.lit(False))


def header_map(columns: Sequence[str], wanted: Sequence[str] = tuple(const.PRODUCT_COLUMNS)) -> dict[str, str]:
    """Wanted name to actual header, compared trimmed and without case."""
    by_key = {c.strip().lower(): c for c in columns if c.strip()}
    return {name: by_key[name.lower()] for name in wanted if name.lower() in by_key}


def coerce_product_cells(df: DataFrame) -> DataFrame:
    """Typed catalogue columns from untyped cells; missing optional columns are null."""
    found, kinds = header_map(df.columns), dict(df.dtypes)
    missing = [name for name in const.REQUIRED_PRODUCT_COLUMNS if name not in found]
    if missing:
        raise ValueError(f"required columns not found: {', '.join(missing)}")

    def typed(name: str, target: str) -> Column:
        if name not in found:
            return F.lit(None).cast(target).alias(name)
        return cells.coerce(_named(found[name]), kinds[found[name]], target).alias(name)

    return df.select(*[typed(name, target) for name, target in const.PRODUCT_COLUMNS.items()])


def require_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail when a column is missing; drop rows where one of them is null or blank."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"required columns not found: {', '.join(missing)}")
    for name in columns:
        df = df.filter(not_blank(_named(name).cast("string")))
    return df


def nonblank_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(not_blank(_named(column)))


def content_column(columns: Sequence[str]) -> str:
    """The first of content, description, name that the table has, in any case."""
    by_key = {c.lower(): c for c in columns}
    for name in const.CONTENT_COLUMN_PRIORITY:
        if name in by_key:
            return by_key[name]
    raise ValueError("no content column")


def resolve_content(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Map any table onto the corpus contract; `mapping` is contract name to column name."""
    chosen = {"content": content_column(df.columns), **mapping} if "content" not in mapping else mapping
    absent = {
        "embedding": "array<float>", "file_name": "string", "page_number": "int", "chunk_index": "int",
    }
    fixed = [_named(column).alias(name) for name, column in chosen.items()]
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in absent.items() if name not in chosen]
    return df.select(*fixed, *blank)


def check_requests(
    requests: DataFrame, top_k: int = const.CHAT_TOP_K, threshold: float = const.CHAT_THRESHOLD
) -> DataFrame:
    """Requests with defaults filled, their reasons for rejection and a `valid` flag.

    Only a null takes the default: an explicit threshold of 0.0 is kept.
    """
    filled = requests.withColumns(
        {
            "top_k": F.coalesce("top_k", F.lit(top_k)).cast("int"),
            "threshold": F.coalesce("threshold", F.lit(threshold)).cast("double"),
            "min_suggestions": F.coalesce("min_suggestions", F.lit(const.MIN_SUGGESTIONS)).cast("int"),
        }
    )
    reasons = F.array_compact(
        F.array(
            F.when(~not_blank(F.col("query")), F.lit("empty query")),
            F.when(F.char_length("query") > const.MAX_QUERY_CHARS, F.lit("query too long")),
            F.when(~F.col("top_k").between(1, const.MAX_TOP_K), F.lit("top_k out of range")),
            F.when(~F.col("threshold").between(0.0, 1.0), F.lit("threshold out of range")),
            F.when(F.col("min_suggestions") < 1, F.lit("min_suggestions out of range")),
        )
    )
    return filled.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def validate_requests(requests: DataFrame, **defaults) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) requests."""
    checked = check_requests(requests, **defaults)
    return checked.filter("valid").drop("reasons", "valid"), checked.filter(~F.col("valid"))


def profile_columns(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """One row per column: type, values present, longest text form, and whether nulls occur; one scan."""
    plain = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    aggregates = [F.count("*").alias("_rows")]
    for i, (name, kind) in enumerate(plain):
        c = _named(name)
        text = F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")
        aggregates += [F.count(c).alias(f"n{i}"), F.max(F.char_length(text)).alias(f"l{i}")]
        if approx_distinct:
            aggregates.append(F.approx_count_distinct(c).alias(f"d{i}"))
    row = df.agg(*aggregates)
    items = []
    for i, (name, kind) in enumerate(plain):
        fields = [
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.col(f"n{i}").alias("values_present"),
            F.col(f"l{i}").cast("long").alias("max_length"),
            (F.col(f"n{i}") < F.col("_rows")).alias("has_nulls"),
        ]
        if approx_distinct:
            fields.append(F.col(f"d{i}").alias("approx_distinct"))
        items.append(F.struct(*fields))
    return row.select(F.inline(F.array(*items)))
