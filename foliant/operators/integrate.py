"""Fields and line items of a document brought together, and the total that they support.

Fields are a row for each (doc_id, page); items are grouped by the same keys, so one co-located join puts them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

TOLERANCE = 0.02

# Column -> names that it may have, in order of preference.
ALIASES = {
    "page": ["page_number", "page", "source_page"],
    "type": ["row_type", "type", "item_type"],
    "charge_type": ["charge_type", "charge", "charge_category"],
    "description": ["description", "product_description", "item_description"],
    "quantity": ["quantity", "qty"],
    "unit_price": ["unit_price", "unit_amount", "price"],
    "discount": ["discount", "discount_amount"],
    "net_amount": ["net_amount", "net", "amount_before_tax"],
    "tax_rate": ["tax_rate", "tax_percentage"],
    "tax_type": ["tax_type", "tax_component"],
    "tax_amount": ["tax_amount", "tax"],
    "total_amount": ["total_amount", "total"],
    "asin": ["asin", "product_code", "item_code"],
    "hsn": ["hsn", "hsn_code", "sac", "service_code"],
    "validation": ["validation", "status", "validation_status"],
}
NUMBERS = ["quantity", "unit_price", "discount", "net_amount", "tax_amount", "total_amount"]


def conform(rows: DataFrame, aliases: dict[str, list[str]] = ALIASES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows under the names of `aliases`, each the first of its names that holds something; what has no name there goes to source_observations.

    Values stay as observed, with words for nothing folded to null; the numbers among them are in columns that end in _value.
    """
    names = {a for xs in aliases.values() for a in xs}
    have = set(rows.columns)
    one = {n: F.coalesce(*[tx.folded(F.col(a).cast("string")) for a in xs if a in have], F.lit(None).cast("string")) for n, xs in aliases.items()}
    rest = [c for c in rows.columns if c not in names and c not in keep]
    observed = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[tx.folded(F.col(c).cast("string")) for c in rest])), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    a = rows.select(*keep, *[c.alias(n) for n, c in one.items()], observed.alias("source_observations"))
    page = F.coalesce(F.col("page").try_cast("double").cast("int").cast("string"), F.col("page"))
    return a.withColumns({"page": page, "type": F.lower("type"), **{f"{n}_value": tx.number(F.col(n)) for n in NUMBERS}})


def attached(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents (doc_id, page, ...fields) with items, charges, other_rows and their counts.

    Rows go to the document of their page. Rows without a page go to the only document there is, if no row has its page.
    """
    # Rows are sorted, and maps have no order: their entries stand for them.
    rows = rows.withColumns({f.name: F.array_sort(F.map_entries(f.name)) for f in rows.schema if f.dataType.typeName() == "map"})
    order = "row_number" if "row_number" in rows.columns else None
    item = F.struct(*([F.col(order).cast("int").alias("row_number")] if order else []), *[F.col(c) for c in rows.columns if c not in ("doc_id", "page", order)])
    grouped = rows.groupBy("doc_id", F.coalesce("page", F.lit("")).alias("r_page")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    docs = fields.withColumn("r_page", F.col("page").cast("string")).selectExpr("*", "count(*) over (partition by doc_id) as pages")
    own = docs.join(grouped, ["doc_id", "r_page"], "left")
    loose = grouped.where("r_page = ''").select("doc_id", F.col("rows").alias("loose"))
    a = own.join(loose, "doc_id", "left").withColumn("rows", F.expr("coalesce(rows, if(pages = 1, loose, null))")).drop("loose", "pages", "r_page")
    a = a.withColumn("rows", F.coalesce("rows", F.array().cast(a.schema["rows"].dataType)))
    pick = lambda cond: F.expr(f"filter(rows, x -> {cond})")
    charge = "coalesce(x.type in ('charge', 'fee', 'service'), false)"
    a = a.withColumns({"items": pick("x.type = 'product'"), "charges": pick(charge), "other_rows": pick(f"not coalesce(x.type = 'product', false) and not {charge}")})
    n = lambda c: F.size(c)
    return a.withColumns({"table_row_count": n("rows"), "table_product_count": n("items"), "table_charge_count": n("charges")}).drop("rows")


def resolved(docs: DataFrame, total: str = "observed_total") -> DataFrame:
    """Adds total_amount and total_resolution. Sums are of cents, so they are exact."""
    cents = lambda c: f"aggregate(filter(transform({c}, x -> x.total_amount_value), v -> v is not null), 0L, (s, v) -> s + bigint(round(v * 100)))"
    some = lambda c: f"exists({c}, x -> x.total_amount_value is not null)"
    a = docs.selectExpr("*", f"{some('items')} as r_products", f"coalesce({some('charges')}, false) as r_charges", f"{cents('items')} / 100 as r_sum", f"{cents('charges')} / 100 as r_fees")
    how = f"""case when not coalesce(r_products, false) and r_charges then 'sum_of_charge_totals' when not coalesce(r_products, false) then 'field_extractor_observation'
      when abs({total} - r_sum) <= {TOLERANCE} then 'validated_product_total_sum' when {total} is null then 'sum_of_product_totals' else 'document_level_observation_with_additional_components' end"""
    a = a.withColumn("total_resolution", F.expr(how))
    value = f"case total_resolution when 'sum_of_charge_totals' then r_fees when 'validated_product_total_sum' then r_sum when 'sum_of_product_totals' then r_sum else {total} end"
    return a.withColumn("total_amount", F.expr(value)).drop("r_products", "r_charges", "r_sum", "r_fees")


def with_class(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds document_type from the classification, INVOICE where there is none."""
    return docs.join(classes.select("doc_id", F.col("document_type").alias("c_type")), "doc_id", "left").withColumn("document_type", F.coalesce("c_type", F.lit("INVOICE"))).drop("c_type")


def as_json(docs: DataFrame) -> DataFrame:
    """(doc_id, json): every document of an input as one text, nulls written out."""
    row = F.struct(*[c for c in docs.columns if c != "doc_id"])
    return docs.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.to_json(row, {"ignoreNullFields": "false"}))).alias("documents"))).alias("json"))


def amount(c: Column) -> Column:
    return tx.number(c)
