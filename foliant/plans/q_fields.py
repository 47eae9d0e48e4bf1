"""Queries on fields: each extractor, the totals of a page and its line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fields, layout, spatial
from . import fixtures as fx
from .q_reading import BLOCKS, REGIONS, pages


def regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.unpaged(page_regions(spark, d))


def page_regions(spark: SparkSession, d: str) -> DataFrame:
    return spatial.assigned_pages(pages(spark, d))


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    """Regions of which every third row stands again, further down in the table and with another text: the first of them stays."""
    a = page_regions(spark, d)
    held = lambda x, line, **put: F.struct(*[put.get(n, x[n]).alias(n) for n in layout.names(a)], F.lit(line).alias("line"))
    again = F.transform(F.filter("blocks", lambda x: x["block_number"] % 3 == 0), lambda x: held(x, 2, text=F.lit("again")))
    twice = a.withColumn("blocks", F.concat(F.transform("blocks", lambda x: held(x, 1)), again))
    return fields.observed_pages(twice, "line").selectExpr("doc_id", "bigint(size(obs)) as n", "aggregate(obs, 0L, (s, x) -> s + x.block_number) as blocks", "bigint(size(filter(obs, x -> x.text = 'again'))) as n_again")


def _flat(*names: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return fields.observed_pages(page_regions(spark, d), names=[r for n in names for r in _REGIONS_OF[n]]).select("doc_id", *[c for n in names for c in _PARTS[n]()])

    return query


def _spread(prefix: str, column, *fields_: str):
    return [column[f].alias(f"{prefix}{f}") for f in fields_]


_PARTS = {
    "invoice": lambda: _spread("invoice_", fields.invoice(), "number", "details", "date"),
    "order": lambda: _spread("order_", fields.order(), "number", "date"),
    "seller": lambda: _spread("seller_", fields.seller(), "name", "address", "pan", "gstin"),
    "billing": lambda: _spread("billing_", fields.party("BILLING"), "name", "address", "state_code"),
    "shipping": lambda: _spread("shipping_", fields.party("SHIPPING"), "name", "address", "state_code"),
    "supply": lambda: _spread("", fields.supply(), "place_of_supply", "place_of_delivery"),
    "payment": lambda: _spread("", fields.payment(), "transaction_id", "date_time", "invoice_value", "mode"),
    "reverse": lambda: [fields.reverse_charge().alias("reverse_charge")],
    "words": lambda: [fields.words().alias("amount_in_words")],
}
#: The regions that each of them reads.
_REGIONS_OF = {
    "invoice": ["INVOICE_DETAILS"], "order": ["ORDER"], "seller": ["SELLER", "SELLER_TAX"], "billing": ["BILLING"], "shipping": ["SHIPPING"], "supply": ["SUPPLY_DELIVERY"],
    "payment": ["PAYMENT"], "reverse": ["REVERSE_CHARGE"], "words": ["AMOUNT_IN_WORDS"],
}
_REGION_NAMES = ("SELLER", "BILLING", "PRODUCT_TABLE", "TOTAL", "PAYMENT")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return fx.frame(spark, d, "inv_text")


QUERIES = {
    "observations_once": lambda s, d: _repeated(s, d),
    "region_text": lambda s, d: fields.observed_pages(page_regions(s, d), names=_REGION_NAMES).select("doc_id", *[F.md5(fields.joined(n)).alias(n.lower()) for n in _REGION_NAMES]),
    "field_invoice": _flat("invoice"),
    "field_order": _flat("order"),
    "field_seller": _flat("seller"),
    "field_party": _flat("billing", "shipping"),
    "field_supply": _flat("supply"),
    "field_payment": _flat("payment"),
    "field_reverse": _flat("reverse"),
    "field_words": _flat("words"),
    "field_total_proximity": lambda s, d: fields.with_totals(fields.observed_pages(page_regions(s, d))).select("doc_id", "tax_amount", "total_amount"),
    "product_bands": lambda s, d: fields.bands(regions(s, d)).selectExpr("doc_id", "band", "text", "cast(score as bigint) as score", "cast(size(amounts) as bigint) as n_amounts", "hsn"),
    "product_primary": lambda s, d: fields.primary_item(regions(s, d)).drop("page_number"),
    "money_parse": lambda s, d: _texts(s, d).select("doc_id", F.array_join(tx.field_amounts(F.col("text")), " ").alias("field_amounts"), F.array_join(tx.table_amounts(F.col("text")), " ").alias("table_amounts"), F.size(tx.spatial_amounts(F.col("text"))).cast("long").alias("n_spatial")),
    "percent_parse": lambda s, d: fx.frame(s, d, "inv_blocks").where("text like '%\\%%'").select("doc_id", "block_number", F.get(tx.percentages(F.col("text")), F.lit(0)).alias("rate"), tx.percentage(F.col("text")).alias("first_number")),
    "number_parse": lambda s, d: fx.frame(s, d, "inv_blocks").select("doc_id", "block_number", tx.number(F.col("text")).alias("number"), tx.amount(F.col("text")).alias("amount")),
    "null_fold": lambda s, d: _null_cases(s, d).select("order_key", tx.folded(F.col("raw")).alias("folded"), tx.number(F.col("raw")).alias("number")),
    "validate_ids": lambda s, d: fx.frame(s, d, "inv_fields").select("doc_id", tx.valid_pan(F.col("pan")).alias("pan_ok"), tx.valid_gstin(F.col("gstin")).alias("gstin_ok"), tx.valid_state(F.col("billing_state")).alias("state_ok"), tx.valid_identifier(F.col("invoice_number")).alias("number_ok")),
}

_CASES = ["''", "' N/A '", "'none'", "'NaN'", "'unknown'", "' 1,234.50 '", "'$5'", "'-7'", "'abc'", "'12x'", "cast(null as string)"]
_CASE = "case o_orderkey % 11 " + " ".join(f"when {i} then {c}" for i, c in enumerate(_CASES)) + " end"


def _null_cases(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as order_key", f"{_CASE} as raw")


_R = f"{BLOCKS}, {REGIONS}"
_CUR = r"(?:₹|Rs\.?|INR|\$|€|£)?"


def _text(name: str) -> str:
    return f"string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' order by y_start, x_start, block_number) filter ((spatial_region = '{name}' or section = '{name}') and trim(text) <> '')"


def _list(name: str) -> str:
    return f"coalesce(list(trim(regexp_replace(text, '\\s+', ' ', 'g')) order by y_start, x_start, block_number) filter ((spatial_region = '{name}' or section = '{name}') and trim(text) <> ''), [])"


def _get(column: str, *patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({column}, '{p}', 1, 'i')), '')" for p in patterns) + ", '')"


def _from(regions_: list[str], select: str) -> str:
    return f"{_R}, f as (select doc_id, " + ", ".join(f"coalesce({_text(n)}, '') as {n.lower()}_t" for n in regions_) + f" from reg group by doc_id) select doc_id, {select} from f"


def _party(name: str) -> str:
    p = name.lower()
    return f"""{p} as (select doc_id, case when len(ls) > 0 then ls[1] else '' end as name, list_filter(ls[2:], lambda x: upper(x) not in ('IN', 'INDIA') and upper(x) <> upper(ls[1])) as rest
      from (select doc_id, list_filter({_list(name)}, lambda x: not regexp_full_match(x, '((Billing|Shipping)\\s+Address|Sold\\s+By|Seller|Supplier|Vendor)\\s*[:\\-]?', 'i')) as ls from reg group by doc_id))"""


_STATE = r"\bState\s*/?\s*UT\s*Code\s*[:\-]?\s*(\d{1,3})"


def _party_columns(p: str) -> str:
    return f"""{p}.name as {p}_name, array_to_string(list_filter({p}.rest, lambda x: not regexp_matches(x, '{_STATE}', 'i')), ', ') as {p}_address,
      coalesce(regexp_extract(list_filter({p}.rest, lambda x: regexp_matches(x, '{_STATE}', 'i'))[-1], '{_STATE}', 1, 'i'), '') as {p}_state_code"""


_LABEL = r"(regexp_matches(text, '\b(GRAND\s+TOTAL|INVOICE\s+TOTAL|TOTAL\s+AMOUNT|AMOUNT\s+(DUE|PAYABLE)|BALANCE\s+DUE)\b', 'i') or (regexp_matches(text, '(^|[^A-Z])TOTAL', 'i') and not regexp_matches(text, '(^|[^A-Z])TOTAL\s+TAX(ES)?\b', 'i')))"
_MONEY_OF = r"regexp_extract_all(text, '\d{1,3}(?:,\d{3})*\.\d{2}')"
# Whole numbers stand between blanks in these texts, so they are found word by word.
_LOOSE_OF = r"list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '-?\d{1,3}(,\d{3})*(\.\d{1,2})?') and (contains(x, '.') or contains(x, ',') or try_cast(x as double) >= 10))"
_VALUES = f"case when len({_MONEY_OF}) > 0 then {_MONEY_OF} else {_LOOSE_OF} end"
_TOTALS = rf"""v as materialized (select *, {_VALUES} as vs, {_LABEL} as islabel, spatial_region = 'TOTAL' or section = 'TOTAL' as own from reg),
  tt as (select doc_id, coalesce(string_agg(text, ' ' order by y_start, x_start, block_number) filter (own), '') as t from v group by doc_id),
  mk as (select doc_id, arg_max(block_number, cast(y_start as bigint) * 1000000000 + x_start * 100000 + block_number) as b, arg_max(y_start, cast(y_start as bigint) * 1000000000 + x_start * 100000 + block_number) as y, arg_max(y_end, cast(y_start as bigint) * 1000000000 + x_start * 100000 + block_number) as ye,
    arg_max(x_start, cast(y_start as bigint) * 1000000000 + x_start * 100000 + block_number) as x, arg_max(x_end, cast(y_start as bigint) * 1000000000 + x_start * 100000 + block_number) as xe from v where islabel group by doc_id),
  cand as (select v.doc_id, v.vs[-1] as val, row_number() over (partition by v.doc_id order by case when abs(v.y_start - mk.y) <= greatest(12, abs(ye - mk.y)) then 0 else 1 end,
      case when abs(v.y_start - mk.y) <= greatest(12, abs(ye - mk.y)) then (case when v.x_start >= xe then 0 else 1 end) else abs(v.y_start - mk.y) end,
      case when abs(v.y_start - mk.y) <= greatest(12, abs(ye - mk.y)) then (case when v.x_start >= xe then v.x_start - xe when v.x_end <= mk.x then mk.x - v.x_end else 0 end) else abs(v.x_start - mk.x) end, v.y_start, v.x_start, v.block_number) as rn
    from v join mk using (doc_id) where v.block_number <> mk.b and len(v.vs) > 0 and abs(v.y_start - mk.y) <= greatest(120, abs(ye - mk.y))),
  mk2 as (select doc_id, arg_max(block_number, cast(y_start as bigint) * 1000000000 + x_start * 100000 + block_number) as b, arg_max(y_start, cast(y_start as bigint) * 1000000000 + x_start * 100000 + block_number) as y from v where islabel and own group by doc_id),
  cand2 as (select v.doc_id, v.vs[-1] as val, row_number() over (partition by v.doc_id order by abs(v.y_start - mk2.y), v.y_start, v.x_start, v.block_number) as rn from v join mk2 using (doc_id) where own and v.block_number <> mk2.b and len(v.vs) > 0),
  low2 as (select doc_id, arg_max(vs[-1], cast(y_start as bigint) * 1000000000 + x_start * 100000 + block_number) as val from v where own and len(vs) > 0 group by doc_id)
select tt.doc_id, replace({_get('t', r"(?:Total\s+Tax(?:es)?|Tax\s+Amount|Tax\s+Total)\s*[:#\-]?\s*" + _CUR + r"\s*([0-9,]+(?:\.\d{1,2})?)")}, ',', '') as tax_amount,
  replace(coalesce(nullif({_get('t', r"(?:Grand\s+Total|Total\s+Amount|Invoice\s+Total|Amount\s+(?:Due|Payable)|Balance\s+Due)\s*[:#\-]?\s*" + _CUR + r"\s*([0-9,]+(?:\.\d{1,2})?)", r"\bTOTAL\s*[:#\-]?\s*" + _CUR + r"\s*([0-9,]+(?:\.\d{1,2})?)")}, ''), cand.val, cand2.val, low2.val, ''), ',', '') as total_amount
from tt left join cand on cand.doc_id = tt.doc_id and cand.rn = 1 left join cand2 on cand2.doc_id = tt.doc_id and cand2.rn = 1 left join low2 on low2.doc_id = tt.doc_id"""

_TAXWORD = r"\b(CGST|SGST|IGST|UTGST|VAT|SALES\s+TAX)\b"
_BANDS = rf"""t0 as (select *, spatial_region = 'PRODUCT_TABLE' or section = 'PRODUCT_TABLE' as intable from reg),
  t1 as (select *, bool_or(intable) over (partition by doc_id) as hastable from t0),
  t2 as (select doc_id, block_number, trim(text) as text, x_start, y_start, y_start - lag(y_start) over (partition by doc_id order by y_start, x_start, block_number) as step from t1 where (intable or not hastable) and trim(text) <> '' and not regexp_full_match(upper(trim(text)), '{fields.HEADERS}') and upper(trim(text)) not in ('NET TAX TAX TAX TOTAL', 'NET TAX TOTAL')),
  t3 as (select *, greatest(18, least(90, cast(0.9 as double) * coalesce(median(case when step > 0 then step end) over (partition by doc_id), 50))) as gap from t2),
  t4 as (select *, sum(case when step is null or step > gap then 1 else 0 end) over (partition by doc_id order by y_start, x_start, block_number) as band from t3),
  t5 as (select doc_id, cast(band as bigint) as band, string_agg(text, ' ' order by y_start, x_start, block_number) as text, min(y_start) as y, any_value(gap) as gap from t4 group by all),
  t6 as (select *, {_MONEY_OF} as vs, {_get('text', r"\bHSN\s*[:#\-]?\s*(\d{4,12})\b")} as hsn, {_get('text', r"\bSAC\s*(?:Code|No\.?|Number)?\s*[:#\-]?\s*(\d{4,12})\b")} as sac,
    {_get('text', r"\bASIN\s*[:#\-]?\s*([A-Z0-9]{10})\b", r"\bSKU\s*[:#\-]?\s*([A-Z0-9._/-]+)", r"\bItem\s+(?:Code|ID|Number)\s*[:#\-]?\s*([A-Z0-9._/-]+)", r"\bProduct\s+(?:Code|ID|Number)\s*[:#\-]?\s*([A-Z0-9._/-]+)")} as ident, regexp_matches(text, '{_TAXWORD}', 'i') as hastax from t5),
  bands as materialized (select *, case when contains(upper(text), 'SHIPPING CHARGES') or (hastax and not regexp_matches(text, '\b(DESCRIPTION|PRODUCT|ITEM|HSN|SAC|SKU|ASIN)\b', 'i')) then 0 else
    case when len(vs) > 0 then 20 else 0 end + case when len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) >= 2 then 15 else 0 end + case when ident <> '' then 20 else 0 end + case when hsn <> '' then 20 else 0 end + case when sac <> '' then 15 else 0 end
    + case when regexp_matches(text, '\b(Qty|Quantity)\b', 'i') then 10 else 0 end + case when hastax then 5 else 0 end end as score from t6)"""
_AMT = r"\s*[:#\-]?\s*" + _CUR + r"\s*([0-9,]+\.\d{2})"
_PRIMARY = rf"""{_BANDS},
  c1 as (select *, row_number() over (partition by doc_id order by score desc, band) as rank, first_value(y) over (partition by doc_id order by score desc, band) as y1 from bands where score > 0),
  c2 as (select * from c1 where rank = 1 or abs(y - y1) <= greatest(2 * gap, 90)),
  c3 as (select doc_id, string_agg(text, ' ' order by rank) as t, list(text order by rank) as parts, arg_min(vs, rank) as vs, arg_min(hsn, rank) as hsn, arg_min(sac, rank) as sac, arg_min(ident, rank) as ident from c2 group by doc_id),
  c4 as (select *, string_split(t, ' ') as toks, list_distinct(regexp_extract_all(t, '\b(CGST|SGST|IGST|UTGST|VAT)\b', 1)) as tx from c3),
  c5 as (select *, list_transform(range(1, len(toks) + 1), lambda i: {{'w': regexp_extract(toks[i], '(^|[^A-Za-z0-9.,])([0-9]{{1,3}})$', 2), 'p': coalesce(list_sum(list_transform(toks[1:i-1], lambda z: length(z) + 1)), 0) + length(toks[i]) - length(regexp_extract(toks[i], '(^|[^A-Za-z0-9.,])([0-9]{{1,3}})$', 2))}}) as ps,
    list_sort(list_transform(tx, lambda z: lpad(cast(strpos(t, z) as varchar), 6, '0') || z)) as ts,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\b(HSN|SAC|SKU|ASIN|Qty|Quantity|Rate|Price|Unit\s+Price|Net\s+Amount|Line\s+Total|Item\s+Total)\b\s*[:#\-]?\s*[A-Z0-9._/-]*', '', 'gi'),
      '{_TAXWORD}\s*(\d+(\.\d+)?\s*%)?\s*{_CUR}\s*[0-9,]+(\.\d{{2}})?', '', 'gi'), '\b(TOTAL|SUBTOTAL|DISCOUNT)\b.*$', '', 'gi'), '[-−]?\s*{_CUR}\s*\d{{1,3}}(,\d{{3}})*(\.\d{{2}})', '', 'g'), '\s+', ' ', 'g')) as d0 from c4)
select doc_id, coalesce(nullif(d0, ''), list_filter(parts, lambda x: len(regexp_extract_all(x, '[A-Za-z]{{2,}}')) >= 2)[1], '') as description,
  coalesce(nullif(regexp_extract(t, '\b(?:Qty|Quantity)\s*[:#\-]?\s*([0-9]+(?:\.[0-9]+)?)\b', 1, 'i'), ''), list_filter(ps, lambda z: regexp_full_match(z.w, '[0-9]{{1,3}}') and not contains(substr(t, cast(greatest(1, z.p - 9) as bigint), cast(least(10, z.p) as bigint)), '%') and not contains(substr(t, cast(z.p + length(z.w) + 1 as bigint), 10), '%'))[1].w, '') as quantity,
  replace(coalesce(nullif({_get('t', r"\b(?:Unit\s+Price|Rate|Price)" + _AMT)}, ''), vs[1], ''), ',', '') as unit_price,
  array_to_string(list_transform(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(t, '\b(\d+(?:\.\d+)?)\s*%', 1)), lambda z: lpad(cast(strpos(t, z || '%') as varchar), 6, '0') || z)), lambda z: z[7:]), lambda z: z || '%'), '/') as tax_rate,
  array_to_string(list_transform(ts, lambda z: z[7:]), '/') as tax_type,
  coalesce(regexp_extract_all(substr(t, cast(strpos(t, ts[1][7:]) as bigint) + length(ts[1][7:]), 100), '\d{{1,3}}(?:,\d{{3}})*\.\d{{2}}')[1], '') as tax_amount,
  replace(coalesce(nullif({_get('t', r"\b(?:Line\s+Total|Item\s+Total|Amount)" + _AMT)}, ''), vs[-1], ''), ',', '') as total_amount,
  coalesce(nullif(hsn, ''), {_get('t', r"\bHSN\s*[:#\-]?\s*(\d{4,12})\b")}) as hsn, coalesce(nullif(sac, ''), {_get('t', r"\bSAC\s*(?:Code|No\.?|Number)?\s*[:#\-]?\s*(\d{4,12})\b")}) as sac,
  ident as product_identifier, {_get('t', r"\bDiscount" + _AMT)} as discount, {_get('t', r"\b(?:Net\s+Amount|Net)" + _AMT)} as net_amount from c5"""

ORACLE_SQL = {
    "observations_once": f"{_R} select doc_id, count(*) as n, cast(sum(block_number) as bigint) as blocks, cast(0 as bigint) as n_again from reg group by doc_id",
    "region_text": _from(list(_REGION_NAMES), ", ".join(f"md5({n.lower()}_t) as {n.lower()}" for n in _REGION_NAMES)),
    "field_invoice": _from(["INVOICE_DETAILS"], ", ".join((
        _get("invoice_details_t", r"\bInvoice\s+(?:Number|No\.?)\s*[:#\-]?\s*([A-Z0-9][A-Z0-9./_-]*)") + " as invoice_number",
        _get("invoice_details_t", r"\bInvoice\s+Details?\s*[:#\-]?\s*(.+?)(?:\s+Invoice\s+Date\b|$)") + " as invoice_details",
        _get("invoice_details_t", r"\bInvoice\s+Date\s*[:#\-]?\s*([0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4})") + " as invoice_date"))),
    "field_order": _from(["ORDER"], _get("order_t", r"\bOrder\s+(?:Number|No\.?|ID)\s*[:#\-]?\s*([A-Z0-9][A-Z0-9./_-]*)") + " as order_number, " + _get("order_t", r"\bOrder\s+Date\s*[:#\-]?\s*([0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4})") + " as order_date"),
    "field_seller": f"{_R}, {_party('SELLER')}, tax as (select doc_id, coalesce({_text('SELLER_TAX')}, '') as t from reg group by doc_id) select doc_id, name as seller_name, array_to_string(rest, ', ') as seller_address, "
    + _get("t", r"\bPAN\s*(?:No\.?|Number)?\s*[:#\-]?\s*([A-Z0-9]{8,20})") + " as seller_pan, " + _get("t", r"\bGST(?:IN)?\s*(?:Registration\s+No\.?|No\.?|Number)?\s*[:#\-]?\s*([A-Z0-9]{10,20})") + " as seller_gstin from seller join tax using (doc_id)",
    "field_party": f"{_R}, {_party('BILLING')}, {_party('SHIPPING')} select doc_id, {_party_columns('billing')}, {_party_columns('shipping')} from billing join shipping using (doc_id)",
    "field_supply": _from(["SUPPLY_DELIVERY"], _get("supply_delivery_t", r"\bPlace\s+of\s+Supply\s*[:\-]?\s*(.+?)(?:\s+Place\s+of\s+Delivery\b|$)") + " as place_of_supply, " + _get("supply_delivery_t", r"\bPlace\s+of\s+Delivery\s*[:\-]?\s*(.+)$") + " as place_of_delivery"),
    "field_payment": _from(["PAYMENT"], ", ".join((
        _get("payment_t", *[rf"\b{p}\s*[:#\-]?\s*([A-Z0-9._/-]{{4,}})" for p in (r"Payment\s+Transaction\s+ID", r"Transaction\s+ID", r"Transaction\s+Reference")]) + " as transaction_id",
        _get("payment_t", r"\bDate\s*(?:&|and)\s*Time\s*[:#\-]?\s*([0-9./-]+(?:\s*,\s*|\s+)[0-9:]+)", r"\bPayment\s+Date\s*[:#\-]?\s*([0-9./-]+)") + " as date_time",
        "replace(" + _get("payment_t", r"\bInvoice\s+Value" + _AMT, r"\bPayment\s+Amount" + _AMT) + ", ',', '') as invoice_value",
        _get("payment_t", *[rf"\b{p}\s*[:#\-]?\s*([A-Za-z][A-Za-z0-9 /_-]{{1,40}})" for p in (r"Mode\s+of\s+Payment", r"Payment\s+Method", r"Payment\s+Mode")]) + " as mode"))),
    "field_reverse": _from(["REVERSE_CHARGE"], _get("reverse_charge_t", r"\bReverse\s+Charge\s*[:#\-]?\s*(Yes|No)\b") + " as reverse_charge"),
    "field_words": rf"""{_R}, l as (select doc_id, trim(text) as text, row_number() over (partition by doc_id order by y_start, x_start, block_number) as i from reg where spatial_region = 'AMOUNT_IN_WORDS' or section = 'AMOUNT_IN_WORDS'),
      m as (select *, regexp_matches(text, '\bAmount\s+in\s+Words\b', 'i') as lab, regexp_matches(text, '(?i)^For\s+.+:\s*$') or regexp_matches(text, '\bAuthori[sz]ed\s+Signatory\b', 'i') as st from l),
      n as (select *, min(case when lab then i end) over (partition by doc_id) as b from m), o as (select *, min(case when st and not lab and i > b then i end) over (partition by doc_id) as e from n),
      r as (select doc_id, string_agg(nullif(trim(regexp_replace(text, '\bAmount\s+in\s+Words\b\s*[:#\-]?', '', 'gi')), ''), ' ' order by i) as amount_in_words from o where i >= b and (e is null or i < e) group by doc_id)
      select d.doc_id, coalesce(amount_in_words, '') as amount_in_words from (select distinct doc_id from reg) d left join r using (doc_id)""",
    "field_total_proximity": f"{_R}, {_TOTALS}",
    "product_bands": f"{_R}, {_BANDS} select doc_id, band, text, cast(score as bigint) as score, len(vs) as n_amounts, hsn from bands",
    "product_primary": f"{_R}, {_PRIMARY}",
    "money_parse": rf"""{fx.duckdb('inv_text')} select doc_id, array_to_string(regexp_extract_all(text, '\d{{1,3}}(?:,\d{{3}})*\.\d{{2}}'), ' ') as field_amounts, array_to_string(regexp_extract_all(text, '\d[\d,]*\.\d{{2}}'), ' ') as table_amounts,
      len(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9.,-]', '  ', 'g'), '(^|[^A-Za-z0-9])[0-9][0-9,]*(\.[0-9]{{1,2}})?($|[^A-Za-z0-9])')) as n_spatial from inv_text""",
    "percent_parse": rf"{fx.duckdb('inv_blocks')} select doc_id, block_number, try_cast(regexp_extract(text, '(\d+(?:\.\d+)?)\s*%', 1) as double) as rate, try_cast(regexp_extract(text, '(\d+(?:\.\d+)?)', 1) as double) as first_number from inv_blocks where contains(text, '%')",
    "number_parse": rf"{fx.duckdb('inv_blocks')} select doc_id, block_number, case when regexp_full_match(trim(text), '[+-]?(\d+\.?\d*|\.\d+)') then try_cast(trim(text) as double) end as number, try_cast(nullif(regexp_extract(replace(text, ',', ''), '-?\d+(\.\d+)?'), '') as double) as amount from inv_blocks",
    "null_fold": f"select o_orderkey as order_key, case when lower(trim(raw)) in ('', 'none', 'null', 'nan', 'n/a', 'na', 'unknown') then null else trim(raw) end as folded, case when lower(trim(raw)) in ('', 'none', 'null', 'nan', 'n/a', 'na', 'unknown') then null else try_cast(replace(replace(trim(raw), ',', ''), '$', '') as double) end as number from (select o_orderkey, {_CASE} as raw from orders)",
    "validate_ids": fx.duckdb("inv_fields") + r" select doc_id, coalesce(regexp_full_match(upper(pan), '[A-Z]{5}[0-9]{4}[A-Z]'), false) as pan_ok, coalesce(regexp_full_match(upper(gstin), '[0-9]{2}[A-Z0-9]{13}'), false) as gstin_ok, coalesce(regexp_full_match(billing_state, '\d{2}'), false) as state_ok, coalesce(regexp_full_match(invoice_number, '[A-Za-z0-9][A-Za-z0-9./_-]{3,80}'), false) as number_ok from inv_fields",
}
