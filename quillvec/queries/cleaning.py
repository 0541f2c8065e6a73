from __future__ import annotations

from pyspark.sql import functions as F

from quillvec.operators import clean
from quillvec.plans.load import PROVENANCE, clean_sheet
from quillvec.queries import inputs
from quillvec.queries.inputs import SHEET, SHEET_CELLS, TYPED_PRODUCTS
from quillvec.queries.registry import query


@query("drop_empty_rows", f"WITH {SHEET} SELECT row_index, happened, who, amount FROM filled_cells WHERE n_cells > 0")
def drop_empty_rows(spark, sf):
    kept = clean.drop_empty_rows(inputs.sheet(spark, sf), SHEET_CELLS)
    return kept.select("row_index", "happened", "who", "amount")


@query("drop_sparse_rows", f"WITH {SHEET} SELECT row_index, who, kind, note FROM filled_cells WHERE n_cells >= 3")
def drop_sparse_rows(spark, sf):
    return clean.drop_sparse_rows(inputs.sheet(spark, sf), SHEET_CELLS).select("row_index", "who", "kind", "note")


@query("drop_empty_columns", f"""WITH {SHEET}
SELECT row_index, happened, who, kind, amount, code, note, 'events.csv' AS source_file FROM filled_cells""")
def drop_empty_columns(spark, sf):
    return clean.drop_empty_columns(inputs.sheet(spark, sf), keep=PROVENANCE)


@query("drop_low_density", f"""WITH {SHEET} SELECT row_index, kind, amount FROM filled_cells
WHERE kind IS NOT NULL OR amount IS NOT NULL""")
def drop_low_density(spark, sf):
    return clean.drop_low_density(inputs.sheet(spark, sf), ["kind", "amount"]).select("row_index", "kind", "amount")


@query("normalize_columns", """SELECT c_custkey AS "Name", c_name AS "Name_2", c_nationkey AS "Name_3",
  c_acctbal AS "name_4", c_mktsegment AS "Column_4" FROM customer""")
def normalize_columns(spark, sf):
    """Headers that repeat, one of them in another case, beside one that looks like a suffix."""
    return clean.normalize_columns(inputs.table(spark, sf, "customer").toDF("Name", "Name_2", "Name", "name", "Unnamed: 4"))


# Every value of a column counts. `late` holds short codes first and a sentence in its last rows only.
ROLE_CELLS = """cells AS (
  SELECT 'happened' AS column_name, happened AS value FROM sheet
  UNION ALL SELECT 'who', who FROM sheet UNION ALL SELECT 'kind', kind FROM sheet
  UNION ALL SELECT 'code', code FROM sheet UNION ALL SELECT 'note', note FROM sheet
  UNION ALL SELECT 'dead', dead FROM sheet
  UNION ALL SELECT 'late', CASE WHEN row_index < 500 THEN 'ab' ELSE 'a sentence, row ' || row_index END FROM sheet),
judged AS (
  SELECT column_name, count(value) AS judged, count(try_strptime(value, '%Y-%m-%d %H:%M:%S')) AS dates,
         bool_or(length(value) > 5 AND regexp_matches(value, '\\p{L}')) AS prose
  FROM cells GROUP BY column_name HAVING count(value) > 0)"""


def _late_sheet(spark, sf):
    late = F.when(F.col("row_index") < 500, F.lit("ab")).otherwise(F.concat(F.lit("a sentence, row "), F.col("row_index").cast("string")))
    return inputs.sheet(spark, sf).withColumn("late", late)


@query("infer_column_roles", f"""WITH {SHEET}, {ROLE_CELLS}
SELECT column_name, CASE WHEN dates > judged * 0.5 THEN 'datetime' WHEN prose THEN 'text' ELSE 'ignored' END AS role FROM judged
UNION ALL SELECT 'amount', 'numeric' UNION ALL SELECT 'dead', 'ignored'""")
def infer_column_roles(spark, sf):
    roles = clean.infer_column_roles(_late_sheet(spark, sf), "row_index", skip=["source_file"])
    rows = [(name, role) for role in ("text", "numeric", "datetime", "ignored") for name in getattr(roles, role)]
    return spark.createDataFrame(rows, "column_name string, role string")


@query("text_role_table", f"WITH {SHEET}, {ROLE_CELLS} SELECT * FROM judged WHERE column_name IN ('happened', 'who', 'code', 'late')")
def text_role_table(spark, sf):
    return clean.text_role_table(_late_sheet(spark, sf), ["happened", "who", "code", "late", "dead"]).drop("role")


@query("coerce_fractions", """SELECT event_id, strftime(ts + to_microseconds(event_id % 1000000), '%Y-%m-%d %H:%M:%S.%f') AS happened FROM events""")
def coerce_fractions(spark, sf):
    """Times as text with a fraction of a second, read back to the microsecond."""
    shown = F.date_format(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000000), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = inputs.table(spark, sf, "events").select("event_id", shown.alias("happened"))
    typed = clean.coerce_by_role(rows, clean.Roles(datetime=["happened"]), ["event_id"])
    return typed.withColumn("happened", F.date_format("happened", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("coerce_by_role", f"""WITH {SHEET}
SELECT row_index, who, amount::DOUBLE AS amount, CASE WHEN row_index % 2 = 0 THEN NULL ELSE row_index::DOUBLE END AS number_text,
       CASE WHEN row_index % 5 = 0 THEN NULL ELSE happened END AS happened FROM sheet""")
def coerce_by_role(spark, sf):
    key = F.col("row_index")
    rows = inputs.sheet(spark, sf).select(
        "row_index", "who", "amount",
        F.when(key % 2 == 0, F.lit("twelve")).otherwise(key.cast("string")).alias("number_text"),
        F.when(key % 5 == 0, F.lit("soon")).otherwise(F.col("happened")).alias("happened"),
    )
    roles = clean.Roles(text=["who"], numeric=["amount", "number_text"], datetime=["happened"])
    typed = clean.coerce_by_role(rows, roles, ["row_index"])
    return typed.withColumn("happened", F.date_format("happened", "yyyy-MM-dd HH:mm:ss"))


def _shown(products):
    return products.withColumns(
        {"price": F.col("price").cast("double"), "last_updated": F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss")}
    )


def _contract_names(products):
    return products.toDF(
        "product_id", "product_name", "category", "description", "price", "stock_quantity", "last_updated"
    )


TYPED_SELECT = """SELECT product_id, product_name, category, description, price::DOUBLE AS price,
  stock_quantity::INTEGER AS stock_quantity, last_updated"""


@query("coerce_product_cells", f"WITH {TYPED_PRODUCTS} {TYPED_SELECT} FROM typed")
def coerce_product_cells(spark, sf):
    return _shown(_contract_names(clean.coerce_product_cells(inputs.product_cells(spark, sf))))


@query("require_fields", f"WITH {TYPED_PRODUCTS} {TYPED_SELECT} FROM kept")
def require_fields(spark, sf):
    typed = _contract_names(clean.coerce_product_cells(inputs.product_cells(spark, sf)))
    return _shown(clean.require_fields(typed, ["product_id", "product_name"]))


@query("clean_sheet", f"""WITH {SHEET}
SELECT row_index, happened, who, kind, amount, code, note, 'events.csv' AS source_file FROM filled_cells WHERE n_cells >= 3""")
def sheet_cleaned(spark, sf):
    return clean_sheet(inputs.sheet(spark, sf))
