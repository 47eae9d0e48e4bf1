"""What a reader of results looks at: cards, sections, tables and texts of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Section -> fields and where they come from; the first that holds something.
SECTIONS = {
    "overview": {"invoice_number": ["invoice.number"], "invoice_date": ["invoice.date"], "order_number": ["order.number"], "total": ["totals.total_amount", "totals.observed_total_amount"]},
    "seller": {"name": ["seller.name"], "address": ["seller.address"], "pan": ["seller.pan"], "gstin": ["seller.gstin"]},
    "customer": {"name": ["billing.name", "shipping.name"], "address": ["billing.address", "shipping.address"], "state_code": ["billing.state_code", "shipping.state_code"]},
    "shipping": {"name": ["shipping.name"], "address": ["shipping.address"], "state_code": ["shipping.state_code"]},
    "supply": {"place_of_supply": ["supply_delivery.place_of_supply"], "place_of_delivery": ["supply_delivery.place_of_delivery"]},
    "totals": {"tax": ["totals.tax_amount"], "total": ["totals.total_amount"], "resolution": ["totals.total_resolution"], "in_words": ["amount_in_words"]},
    "payment": {"transaction": ["payment.transaction_id"], "mode": ["payment.mode"], "value": ["payment.invoice_value"]},
}
PRODUCT_COLUMNS = ["description", "quantity", "unit_price", "net_amount", "tax_type", "tax_rate", "tax_amount", "total_amount", "hsn"]
CHARGE_COLUMNS = ["charge_type", "description", "net_amount", "tax_rate", "tax_amount", "total_amount"]


def cards(docs: DataFrame) -> DataFrame:
    """(doc_id, page, section, field, label, value) of all fields that hold something."""
    rows = [F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), tx.label(F.lit(f)).alias("label"), tx.first_of(*[F.col(c).cast("string") for c in cs]).alias("value")) for s, fs in SECTIONS.items() for f, cs in fs.items()]
    return docs.select("doc_id", "page", F.explode(F.filter(F.array(*rows), lambda r: r["value"].isNotNull())).alias("r")).select("doc_id", "page", "r.*")


def line_table(docs: DataFrame, kind: str) -> DataFrame:
    """The products or charges of documents as a table."""
    columns, rows = (PRODUCT_COLUMNS, "items") if kind == "product" else (CHARGE_COLUMNS, "charges")
    return docs.select("doc_id", "page", F.posexplode(rows).alias("i", "r")).select("doc_id", "page", F.expr("i + 1").alias("n"), *[F.col(f"r.{c}").alias(c) for c in columns])


def generic(pages: DataFrame) -> DataFrame:
    """Texts of documents that are not structured, page by page, safe to show."""
    return pages.select("doc_id", "page_number", tx.escaped(tx.page_text(F.col("text"))).alias("html"), F.octet_length("text").alias("bytes"))


def outcome(runs: DataFrame) -> DataFrame:
    """(status, n, documents) of a batch."""
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), ", ").alias("documents"))
