"""Queries on whole documents: integration, checks and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, export, integrate, validate
from . import fixtures as fx
from . import pipeline

_M = "concat({0} div 100, '.', lpad(string({0} % 100), 2, '0'))"


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a table stage hands them on, some under older names."""
    m = lambda c: _M.format(c)
    rows = fx.frame(spark, d, "inv_items").selectExpr(
        "doc_id", "if(doc_id % 21 = 0, ' N/A ', concat(page_number, '.0')) as page_number", "string(row_number) as row_no", "upper(item_type) as item_type", "if(item_type = 'charge', 'Shipping', null) as charge_type", "description as product_description",
        "if(row_number % 11 = 0, 'unknown', string(qty)) as qty", f"concat('₹', {m('net_c')}) as unit_price", f"if(disc_c > 0, {m('disc_c')}, null) as discount", f"{m('net_c')} as net_amount", "if(tax_type is null, null, concat(rate, '%')) as tax_rate", "tax_type",
        f"if(tax_type is null, null, {m('tax_c')}) as tax", f"if(row_number % 13 = 0, null, {m('total_c')}) as total_amount", "asin", "hsn", "'PASS' as status", "concat(' s', row_number, ' ') as shelf")
    return rows


def items(spark: SparkSession, d: str) -> DataFrame:
    a = integrate.conform(table_rows(spark, d), keep=("doc_id", "row_no"))
    return a.withColumnRenamed("row_no", "row_number")


def fields(spark: SparkSession, d: str) -> DataFrame:
    s = lambda *xs: "struct(" + ", ".join(f"{e} as {n}" for n, e in xs) + ")"
    return fx.frame(spark, d, "inv_fields").selectExpr(
        "doc_id", "1 as page", s(("number", "invoice_number"), ("details", "cast(null as string)"), ("date", "invoice_date")) + " as invoice", s(("number", "order_number"), ("date", "order_date")) + " as `order`",
        s(("name", "seller_name"), ("address", "seller_address"), ("pan", "pan"), ("gstin", "gstin")) + " as seller", s(("name", "billing_name"), ("address", "billing_address"), ("state_code", "billing_state")) + " as billing",
        s(("name", "shipping_name"), ("address", "shipping_address"), ("state_code", "shipping_state")) + " as shipping", s(("place_of_supply", "place_of_supply"), ("place_of_delivery", "place_of_delivery")) + " as supply_delivery",
        s(("transaction_id", "payment_id"), ("date_time", "cast(null as string)"), ("invoice_value", f"if(payment_value_c is null, null, {_M.format('payment_value_c')})"), ("mode", "payment_mode")) + " as payment",
        "'One Hundred Only' as amount_in_words", "if(doc_id % 2 = 0, 'No', null) as reverse_charge", "observed_total_c / 100 as observed_total", f"if(doc_id % 3 = 0, null, {_M.format('sum_tax_c')}) as total_tax", "if(doc_id % 10 = 0, null, double(doc_id * 7 % 101)) as page_confidence")


def documents(spark: SparkSession, d: str) -> DataFrame:
    a = integrate.resolved(integrate.attached(fields(spark, d), items(spark, d)))
    m = lambda c: f"if({c} is null, null, {_M.format(f'bigint(round({c} * 100))')})"
    a = a.withColumn("totals", F.expr(f"struct(total_tax as tax_amount, {m('total_amount')} as total_amount, {m('observed_total')} as observed_total_amount, total_resolution as total_resolution)"))
    types = classify.classified(fx.frame(spark, d, "inv_text")).where("document_type <> 'UNKNOWN'")
    return integrate.with_class(a, types)


def _flat(s: SparkSession, d: str) -> DataFrame:
    return export.flat(documents(s, d))


QUERIES = {
    "integrate_conform": lambda s, d: items(s, d).select("doc_id", F.col("row_number").cast("long").alias("row_number"), "page", "type", "description", "quantity_value", F.expr("bigint(round(unit_price_value * 100))").alias("unit_c"), "validation"),
    "integrate_remainder": lambda s, d: items(s, d).select("doc_id", F.col("row_number").cast("long").alias("row_number"), F.expr("array_join(transform(map_entries(source_observations), e -> concat(e.key, '=', e.value)), ';')").alias("observations")),
    "integrate_attach": lambda s, d: integrate.attached(fields(s, d), items(s, d)).selectExpr("doc_id", "table_row_count as n_rows", "table_product_count as n_products", "table_charge_count as n_charges", "size(other_rows) as n_other", "array_join(transform(items, x -> string(x.row_number)), ' ') as product_rows"),
    "integrate_totals": lambda s, d: integrate.resolved(integrate.attached(fields(s, d), items(s, d))).selectExpr("doc_id", "bigint(round(total_amount * 100)) as total_c", "total_resolution"),
    "integrate_class": lambda s, d: documents(s, d).select("doc_id", "document_type"),
    "validate_checks": lambda s, d: validate.checks(documents(s, d)).selectExpr("doc_id", "substring(check, length(document) + 2) as check", "status", "severity"),
    "validate_messages": lambda s, d: validate.checks(documents(s, d)).select("doc_id", "check", "message"),
    "validate_summary": lambda s, d: validate.summarised(documents(s, d)),
    "validate_report": lambda s, d: validate.report(validate.checks(documents(s, d))).selectExpr("doc_id", "bigint(size(split(text, '\\n'))) as n_lines", "substring_index(text, '\\n', 1) as first_line"),
    "export_flat": lambda s, d: _flat(s, d).select("doc_id", "row_order", *export.COLUMNS),
    "export_sheet_details": lambda s, d: export.sheet(_flat(s, d), "details"),
    "export_sheet_items": lambda s, d: export.sheet(_flat(s, d), "items"),
    "export_sheet_products": lambda s, d: export.sheet(_flat(s, d), "products"),
    "export_sheet_charges": lambda s, d: export.sheet(_flat(s, d), "charges"),
    "export_sheet_validation": lambda s, d: validate.checks(documents(s, d), messages=False).select("doc_id", "document", "check_seq", "check", "status", "severity"),
    "export_sheet_summary": lambda s, d: export.summary(documents(s, d)),
    "end_to_end": lambda s, d: pipeline.run(fx.frame(s, d, "inv_blocks")).summary(),
    "export_widths": lambda s, d: export.widths(_flat(s, d).select(*export.COLUMNS)),
}

_C = "cast({0} // 100 as varchar) || '.' || lpad(cast({0} % 100 as varchar), 2, '0')"
_c = _C.format
_T = "case when row_number % 13 = 0 then null else total_c end"
_B = f"""{fx.duckdb('inv_fields', 'inv_text')},
it as materialized (select *, {_T} as tot from inv_items),
ag as (select doc_id, count(*) as n, count(*) filter (item_type = 'product') as np, count(*) filter (item_type = 'charge') as nc, count(*) filter (item_type = 'other') as no,
  string_agg(cast(row_number as varchar), ' ' order by row_number) filter (item_type = 'product') as prow, sum(tot) filter (item_type = 'product') as ps, sum(tot) filter (item_type = 'charge') as cs,
  count(*) filter (tax_type is not null and item_type in ('product', 'charge')) as ntax from it group by doc_id),
dx as materialized (select f.*, coalesce(n, 0) as n, coalesce(np, 0) as np, coalesce(nc, 0) as nc, coalesce(no, 0) as no, coalesce(prow, '') as prow, ps, cs, coalesce(ntax, 0) as ntax,
  case when ps is null and cs is not null then cs when ps is null then observed_total_c when observed_total_c is null then ps else observed_total_c end as res_c,
  case when ps is null and cs is not null then 'sum_of_charge_totals' when ps is null then 'field_extractor_observation' when observed_total_c is null then 'sum_of_product_totals' when abs(observed_total_c - ps) <= 2 then 'validated_product_total_sum' else 'document_level_observation_with_additional_components' end as how
  from inv_fields f left join ag using (doc_id)),
dt as (select doc_id, case doc_id % 6 when 1 then 'RECEIPT' when 2 then 'GENERAL_DOCUMENT' else 'INVOICE' end as document_type from inv_fields)"""


def _ck(name: str, ok: str, worse: str = "REVIEW", when: str = "true", source: str = "dx") -> str:
    name = name if "||" in name else f"'{name}'"
    return f"select doc_id, {name} as chk, case when coalesce({ok}, false) then 'PASS' else '{worse}' end as status from {source} where {when}"


_PROD, _CH = "(select *, row_number() over (partition by doc_id order by row_number) as k from it where item_type = 'product')", "(select *, row_number() over (partition by doc_id order by row_number) as k from it where item_type = 'charge')"


def _p(n: str, ok: str, worse: str = "REVIEW", when: str = "true") -> str:
    return _ck(f"'product_' || k || '.{n}'", ok, worse, when, _PROD)


def _h(n: str, ok: str, when: str = "true") -> str:
    return _ck(f"'charge_' || k || '.{n}'", ok, "REVIEW", when, _CH)


_KIND = "case when res_c is null or (ps is null and cs is null) then 'line' when ps is not null and cs is null then 'product' when ps is null then 'charge' else 'line' end"
_CHECKS = "ck as materialized (" + "\nunion all ".join([
    _ck("identity", "true"), *[_ck(f"structure.{s}", "true") for s in (*validate.SECTIONS, "line_observations")],
    _ck("invoice.number", "invoice_number is not null", "FAIL"), _ck("invoice.number_structure", "invoice_number <> '#bad'", when="invoice_number is not null"), _ck("invoice.date", "invoice_date is not null", "FAIL"), _ck("order.number", "true"), _ck("order.date", "true"),
    _ck("seller.name", "seller_name is not null", "FAIL"), _ck("seller.address", "true"), _ck("seller.pan", "pan = 'ABCDE1234F'"), _ck("seller.gstin", "gstin = '29ABCDE1234F1Z5'"),
    _ck("billing.name", "true"), _ck("billing.address", "true"), _ck("billing.state_code", "true"), *[_ck(f"shipping.{n}", "doc_id % 4 <> 0") for n in ("name", "address", "state_code")],
    _ck("supply_delivery.place_of_supply", "true"), _ck("supply_delivery.place_of_delivery", "doc_id % 13 <> 0"), _ck("products.present", "np + nc > 0"), _ck("charges.present", "true"),
    _p("description", "description is not null", "FAIL"), _p("quantity", "row_number % 11 <> 0 and qty > 0"), _p("unit_price", "true"), _p("net_amount", "true"), _p("net_calculation", "abs(qty * net_c - net_c) <= 2", when="row_number % 11 <> 0"),
    _p("tax_rate", "tax_type is not null"), _p("tax_type", "tax_type is not null"), _p("tax_amount", "tax_type is not null"), _p("tax_calculation", "abs(net_c * rate - tax_c * 100) <= 200", when="tax_type is not null"),
    _p("total_amount", "tot is not null"), _p("total_calculation", "abs(net_c + tax_c - tot) <= 2", when="tot is not null and tax_type is not null"), _p("identifier", "true"), _p("classification_code", "true"),
    _h("type", "true"), _h("description", "description is not null"), _h("amount", "true"), _h("tax_rate", "true", "tax_type is not null"), _h("tax_amount", "true", "tax_type is not null"), _h("tax_type", "true", "tax_type is not null"),
    _h("total_calculation", "abs(net_c + tax_c - tot) <= 2", "tot is not null and tax_type is not null"), _h("total_amount", "tot is not null"),
    _ck("totals.total_present", "res_c is not null", "FAIL"), _ck("totals.tax_present", "doc_id % 3 <> 0 or ntax > 0"),
    _ck(f"'totals.' || {_KIND} || '_reconciliation'", "(ps is not null or cs is not null) and (abs(coalesce(ps, 0) + coalesce(cs, 0) - res_c) <= 2 or (cs is null and how = 'document_level_observation_with_additional_components'))"),
    _ck("totals.resolution", "true"), _ck("payment.transaction_id", "payment_id is not null"), _ck("payment.mode", "payment_mode <> ''"), _ck("payment.invoice_value", "payment_value_c is not null"),
    _ck("payment.value_reconciliation", "abs(payment_value_c - res_c) <= 2", when="payment_value_c is not null and res_c is not null"), _ck("ocr_confidence", "doc_id % 10 <> 0 and doc_id * 7 % 101 between 70 and 100"),
]) + ")"
_DOC = f"""x as materialized (select d.doc_id, '1' as page, document_type, invoice_number, cast(null as varchar) as invoice_details, invoice_date, order_number, order_date, seller_name, seller_address, pan as seller_pan, gstin as seller_gstin,
  billing_name, billing_address, billing_state as billing_state_code, shipping_name, shipping_address, shipping_state as shipping_state_code, place_of_supply, place_of_delivery,
  case when d.doc_id % 3 <> 0 then {_c('sum_tax_c')} end as invoice_tax_total, case when res_c is not null then {_c('res_c')} end as invoice_total, case when observed_total_c is not null then {_c('observed_total_c')} end as observed_total_amount, how as total_resolution,
  'One Hundred Only' as amount_in_words, case when d.doc_id % 2 = 0 then 'No' end as reverse_charge, payment_id as transaction_id, cast(null as varchar) as payment_date_time, case when payment_value_c is not null then {_c('payment_value_c')} end as invoice_value, payment_mode
  from dx d join dt using (doc_id)),
e as materialized (select x.*, 1 as document_index, cast(coalesce(row_number() over (partition by x.doc_id order by case item_type when 'product' then 0 when 'charge' then 1 else 2 end, row_number) - 1, 0) as int) as row_order, coalesce(item_type, 'document') as row_type,
  case when item_type = 'charge' then 'Shipping' end as charge_type, description, case when row_number % 11 <> 0 then cast(qty as varchar) end as quantity, '₹' || {_c('net_c')} as unit_price, case when disc_c > 0 then {_c('disc_c')} end as discount, {_c('net_c')} as net_amount,
  case when tax_type is not null then rate || '%' end as tax_rate, tax_type, case when tax_type is not null then {_c('tax_c')} end as tax_amount, case when tot is not null then {_c('tot')} end as total_amount, asin, hsn, case when it.doc_id is not null then 'PASS' end as validation
  from x left join it on it.doc_id = x.doc_id)"""
_E = f"{_B}, {_DOC}"


def _pick(name: str) -> str:
    kinds, columns = export.SHEETS[name]
    if kinds is None:
        return f"{_E} select doc_id, {', '.join(columns)} from e where row_order = 0"
    return f"{_E} select doc_id, row_order, {', '.join(columns)} from e where row_type in ({', '.join(repr(k) for k in kinds)})"


ORACLE_SQL = {
    "integrate_conform": f"{fx.duckdb('inv_items')} select doc_id, cast(row_number as bigint) as row_number, case when doc_id % 21 = 0 then null else '1' end as page, item_type as type, description, case when row_number % 11 <> 0 then cast(qty as double) end as quantity_value, net_c as unit_c, 'PASS' as validation from inv_items",
    "integrate_remainder": f"{fx.duckdb('inv_items')} select doc_id, cast(row_number as bigint) as row_number, 'shelf=s' || row_number as observations from inv_items",
    "integrate_attach": f"{_B} select doc_id, cast(n as int) as n_rows, cast(np as int) as n_products, cast(nc as int) as n_charges, cast(no as int) as n_other, prow as product_rows from dx",
    "integrate_totals": f"{_B} select doc_id, cast(res_c as bigint) as total_c, how as total_resolution from dx",
    "integrate_class": f"{_B} select doc_id, document_type from dt",
    "validate_checks": f"{_B}, {_CHECKS} select doc_id, chk as \"check\", status, case status when 'PASS' then 'info' when 'REVIEW' then 'warning' else 'error' end as severity from ck",
    "validate_summary": f"""{_B}, {_CHECKS}, s as (select doc_id, cast(1 as bigint) as total_documents, count(*) as total_checks, count(*) filter (status = 'PASS') as passed, count(*) filter (status = 'FAIL') as failed, count(*) filter (status = 'REVIEW') as review, cast(0 as bigint) as warnings, count(*) filter (status = 'FAIL') as errors from ck group by doc_id)
      select doc_id, case when errors > 0 then 'FAILED' when review > 0 then 'NEEDS_REVIEW' else 'PASSED' end as overall_status, * exclude (doc_id) from s""",
    "validate_report": f"{_B}, {_CHECKS} select doc_id, count(*) as n_lines, '[PASS] document_1_page_1.identity: Document 1 is associated with source page 1.' as first_line from ck group by doc_id",
    "export_flat": f"{_E} select doc_id, row_order, {', '.join(export.COLUMNS)} from e",
    "export_sheet_details": _pick("details"),
    "export_sheet_items": _pick("items"),
    "export_sheet_products": _pick("products"),
    "export_sheet_charges": _pick("charges"),
    "export_sheet_summary": f"{_B} select doc_id, unnest(['documents', 'products', 'charges', 'other_rows']) as metric, cast(unnest([1, np, nc, no]) as bigint) as value from dx",
    "export_widths": f"{_E} " + " union all ".join(f"select '{c}' as \"column\", cast(least(60, greatest(12, greatest(coalesce(max(length(cast({c} as varchar))), 0), {len(c)}) + 2)) as bigint) as width from e" for c in export.COLUMNS),
}
