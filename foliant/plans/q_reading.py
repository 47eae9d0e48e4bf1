"""Queries on reading: classes, routes, sections, words, lines, blocks, anchors and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import classify, layout, spatial
from . import fixtures as fx


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Invoice texts and all documents (ids from 10^9 on) as one relation of documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id + 1000000000 as doc_id", "text")
    return fx.frame(spark, d, "inv_text").select("doc_id", "text").unionAll(docs)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.sectioned(fx.frame(spark, d, "inv_blocks"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return layout.sectioned_pages(fx.block_pages(spark, d))


def words(spark: SparkSession, d: str) -> DataFrame:
    return layout.cleaned(fx.frame(spark, d, "doc_words"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.unpaged(spatial.assigned_pages(pages(spark, d)))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Texts of two pages each, from which documents are put together again."""
    t = fx.frame(spark, d, "inv_text")
    return t.selectExpr("doc_id", "1 as page_number", "text").unionAll(t.selectExpr("doc_id", "2 as page_number", "'Page two of ' || doc_id as text"))


QUERIES = {
    "classify_summary": lambda s, d: classify.classified(fx.frame(s, d, "inv_text")).groupBy("document_type", "confidence").agg(F.count(F.lit(1)).alias("n")),
    "classify_score": lambda s, d: classify.classified(texts(s, d)).select("doc_id", F.col("scores.INVOICE").alias("invoice"), F.col("scores.RECEIPT").alias("receipt"), F.col("scores.GENERAL_DOCUMENT").alias("general")),
    "classify_label": lambda s, d: classify.classified(texts(s, d)).select("doc_id", "document_type", "confidence"),
    "classify_evidence": lambda s, d: classify.classified(fx.frame(s, d, "inv_text")).select("doc_id", F.array_join("evidence.INVOICE", " ").alias("invoice"), F.array_join("evidence.RECEIPT", " ").alias("receipt"), F.array_join("evidence.GENERAL_DOCUMENT", " ").alias("general")),
    "route_vendor": lambda s, d: classify.routed(classify.classified(texts(s, d))).select("doc_id", "route_batch"),
    "route_ui": lambda s, d: classify.routed(classify.classified(texts(s, d))).select("doc_id", "route_upload"),
    "page_texts": lambda s, d: classify.documents(_pages(s, d)).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5")),
    "clean_page_text": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(tx.page_text(F.col("text"))).alias("md5")),
    "progress_stage": lambda s, d: classify.progress(fx.frame(s, d, "log_lines")).select("event_id", "stage", "percent", "label"),
    "section_tag": lambda s, d: blocks(s, d).select("doc_id", "block_number", "section"),
    "section_counts": lambda s, d: blocks(s, d).groupBy("section").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("doc_id").alias("n_docs")),
    "words_clean": lambda s, d: words(s, d).select("doc_id", "word_seq", "text", "right", "bottom", "center_x", "center_y", "conf"),
    "layout_thresholds": lambda s, d: layout.thresholds(words(s, d)).select("doc_id", "y_tolerance", "x_gap"),
    "layout_lines": lambda s, d: layout.lines(words(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.max("line").cast("long").alias("n_lines"), F.sum(F.col("line").cast("long")).alias("line_sum")),
    "layout_blocks": lambda s, d: layout.blocks(words(s, d)).selectExpr("doc_id", "block_number", "text", "cast(x_start as bigint) as x_start", "cast(x_end as bigint) as x_end", "cast(y_start as bigint) as y_start", "cast(y_end as bigint) as y_end", "word_count"),
    "spatial_anchors": lambda s, d: spatial.page_anchors(pages(s, d)).drop("page_number"),
    "spatial_regions": lambda s, d: _regions(s, d).select("doc_id", "block_number", "spatial_region"),
    "region_counts": lambda s, d: spatial.counts(_regions(s, d)),
    "observations_backfill": lambda s, d: spatial.backfilled(_regions(s, d).where("block_number % 5 <> 0"), blocks(s, d)).select("doc_id", "block_number", "section", "spatial_region"),
}

_KEY = "trim(regexp_replace(upper(coalesce({0}, '')), '\\s+', ' ', 'g'))"
_BOTH = fx.duckdb("inv_text") + ", t as (select doc_id, text from inv_text union all select doc_id + 1000000000, text from documents)"


def _score(k: str) -> str:
    return " + ".join(f"case when regexp_matches(u, '{p}') then {w} else 0 end" for p, w in rules.CLASSES[k])


def _classes(of: str) -> str:
    scored = ", ".join(f"{_score(k)} as {n}" for k, n in (("INVOICE", "i"), ("RECEIPT", "r"), ("GENERAL_DOCUMENT", "g")))
    return f"""s as (select doc_id, text, {scored} from (select doc_id, text, {_KEY.format('text')} as u from {of})),
      b as (select *, greatest(i, r, g) as best, list_sort([i, r, g])[2] as second from s),
      c as (select *, case when best = 0 or best = second then 'UNKNOWN' when i = best then 'INVOICE' when r = best then 'RECEIPT' else 'GENERAL_DOCUMENT' end as document_type,
        case when best = 0 or best = second then 0 when best >= 12 and best - second >= 5 then 95 when best >= 9 and best - second >= 4 then 90 when best >= 6 and best - second >= 3 then 80 when best >= 4 and best - second >= 2 then 70 else 55 end as confidence from b)"""


def _evidence(k: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(u, '{p}') then '{p}' end" for p, _ in rules.CLASSES[k]) + "], lambda x: x is not null), ' ')"


def _route(name: str, condition: str) -> str:
    return f"{_BOTH}, {_classes('t')} select doc_id, case when document_type = 'INVOICE' and ({condition}) then 'structured' else 'generic' end as {name} from c"


def _section(text: str) -> str:
    low = f"lower(trim(regexp_replace({text}, '\\s+', ' ', 'g')))"
    parts = []
    for name, ws in rules.SECTIONS:
        hit = f"regexp_matches({low}, '{ws}')" if isinstance(ws, str) else " or ".join(f"contains({low}, '{w}')" for w in ws)
        parts.append(f"when {hit} then '{name}'")
    return "case " + " ".join(parts) + " else '' end"


# RE2 knows no look-around: separators are doubled so that neighbours do not share one.
_AMOUNTS = r"""len(regexp_extract_all(regexp_replace(regexp_replace(text, '[^A-Za-z0-9.,-]', '  ', 'g'), '\.([0-9]{4})', '.  \1', 'g'), '(^|[^A-Za-z0-9])[0-9][0-9,]*(\.[0-9]{1,2})?($|[^A-Za-z0-9])'))"""
BLOCKS = f"{fx.duckdb('inv_blocks')}, k as materialized (select *, {_section('text')} as section, {_AMOUNTS} as amounts from inv_blocks)"


def _anchor(section: str, patterns: list[str]) -> str:
    hit = " or ".join(f"regexp_matches(text, '(?i){p}')" for p in patterns)
    pick = "arg_min(y_start, block_number) filter ({})".format
    return f"cast(coalesce({pick(f'section = {section!r}')}, {pick(hit)}) as double)"


_FOR = r"regexp_matches(text, '(?i)^for\s+.+:\s*$')"
ANCHORS = "an as materialized (select doc_id, 0.55 * cast(max(x_end) as double) as split_x, " + ", ".join(
    [f"{_anchor(s, p)} as a_{n}" for n, (s, p) in spatial.ANCHORS.items()]
    + [f"cast(min(y_start) filter (section = '{s}') as double) as a_{n}" for n, s in spatial.TOPMOST.items()]
    + [rf"cast(min(y_start) filter (section = 'SIGNATORY' or {_FOR} or regexp_matches(text, '(?i)^authorized\s+signatory\b')) as double) as a_sign"]
) + " from k group by doc_id)"

_INF = "cast('infinity' as double)"
REGIONS = rf"""{ANCHORS},
p0 as (select k.*, an.* exclude (doc_id), y_start as y, x_start < split_x as l, x_start >= split_x as r from k join an using (doc_id)),
p1 as (select *, case
  when section in ('SELLER_TAX', 'SUPPLY_DELIVERY', 'PAYMENT', 'SIGNATORY', 'AMOUNT_IN_WORDS') then section
  when section = 'TAX_PAYMENT' then 'REVERSE_CHARGE'
  when section = 'TOTAL' and (regexp_matches(text, '(?i)\btotal\b') or amounts > 0) then 'TOTAL'
  when l and y >= a_seller and a_billing is not null and a_seller_tax is not null and y < a_seller_tax then 'SELLER'
  when l and y >= a_seller and a_billing is not null and a_seller_tax is null and (a_supply is null or y < a_supply) then 'SELLER'
  when l and y >= a_seller_tax and (a_supply is null or y < a_supply) then 'SELLER_TAX'
  when r and y >= a_billing and (a_shipping is null or y < a_shipping) then 'BILLING'
  when r and y >= a_shipping and (a_supply is null or y < a_supply) then 'SHIPPING'
  when r and y >= a_supply and (a_order is null or y < a_order) then 'SUPPLY_DELIVERY'
  when l and y >= a_order and (a_product is null or y < a_product) and (section = 'ORDER' or regexp_matches(text, '(?i)\border\s+(number|date)\b')) then 'ORDER'
  when r and y >= a_invoice and (a_product is null or y < a_product) and (section = 'INVOICE_DETAILS' or regexp_matches(text, '(?i)\binvoice\s+(number|date|details)\b')) then 'INVOICE_DETAILS'
  when y >= a_product and ((a_total is not null and y < a_total) or (a_total is null and y < a_words)) then 'PRODUCT_TABLE'
  when y >= a_words and y < least(coalesce(a_sign, {_INF}), coalesce(a_reverse, {_INF}), coalesce(a_payment, {_INF})) then 'AMOUNT_IN_WORDS'
  when y >= a_sign and y < least(coalesce(a_reverse, {_INF}), coalesce(a_payment, {_INF})) then 'SIGNATORY'
  when y >= a_reverse and (a_payment is null or a_payment = 0 or y < a_payment) then 'REVERSE_CHARGE'
  when y >= a_payment then 'PAYMENT' end as r1 from p0),
p2 as (select *, case when r1 is not null then r1 when section in ('ORDER', 'INVOICE_DETAILS', 'PRODUCT_TABLE', 'TOTAL', 'AMOUNT_IN_WORDS', 'PAYMENT', 'SELLER_TAX', 'SUPPLY_DELIVERY', 'SIGNATORY') then section end as r2,
  (x_start >= split_x or x_end >= split_x) as rightside from p1),
low as (select doc_id, arg_min(block_number, -y * 1000000 + block_number) as block_number from p2 where r2 is null and y < a_total and rightside and amounts >= 2 group by doc_id),
p3 as (select p2.*, case when low.doc_id is not null then 'TOTAL' else r2 end as r3 from p2 left join low on low.doc_id = p2.doc_id and low.block_number = p2.block_number),
p4 as (select *, case when r3 is null and y >= a_product and not (a_total > a_product and y >= a_total and (a_words is null or a_words <= a_product or a_total <= a_words)) and not (a_words > a_product and y >= a_words and (a_total is null or a_total <= a_product or a_words < a_total))
  and y < least(case when a_total > a_product then a_total else {_INF} end, case when a_words > a_product then a_words else {_INF} end)
  and section not in ('PAYMENT', 'SIGNATORY', 'TAX_PAYMENT', 'AMOUNT_IN_WORDS')
  and (section = 'PRODUCT_TABLE' or amounts > 0 or regexp_matches(text, '(?i)\b(hsn|sku|asin|qty|quantity|description)\b')) then 'PRODUCT_TABLE' else r3 end as r4 from p3),
reg as materialized (select doc_id, page_number, block_number, text, x_start, x_end, y_start, y_end, section, amounts,
  case when r4 is null and y < a_words and (a_total is null or y >= a_total) and rightside and amounts >= 1 then 'TOTAL' else coalesce(r4, '') end as spatial_region from p4)"""

_W = f"{fx.duckdb('doc_words')}, w as materialized (select doc_id, page_number, word_seq, line_no, trim(text) as text, \"left\" as x, top, width, height, conf from doc_words where trim(text) <> '')"
_MED = "median(height) over (partition by doc_id)"

ORACLE_SQL = {
    "classify_summary": f"{fx.duckdb('inv_text')}, {_classes('inv_text')} select document_type, confidence, count(*) as n from c group by all",
    "classify_score": f"{_BOTH}, {_classes('t')} select doc_id, i as invoice, r as receipt, g as general from c",
    "classify_label": f"{_BOTH}, {_classes('t')} select doc_id, document_type, confidence from c",
    "classify_evidence": f"{fx.duckdb('inv_text')}, n as (select doc_id, {_KEY.format('text')} as u from inv_text) select doc_id, {_evidence('INVOICE')} as invoice, {_evidence('RECEIPT')} as receipt, {_evidence('GENERAL_DOCUMENT')} as general from n",
    "route_vendor": _route("route_batch", " or ".join(f"contains(lower(text), '{m}')" for m in rules.BATCH_MARKERS)),
    "route_ui": _route("route_upload", "contains(lower(text), 'amazon') and (" + " or ".join(f"contains(lower(text), '{m}')" for m in rules.UPLOAD_MARKERS) + ")"),
    "page_texts": f"{fx.duckdb('inv_text')} select doc_id, length(text || chr(10) || 'Page two of ' || doc_id) as n_chars, md5(text || chr(10) || 'Page two of ' || doc_id) as md5 from inv_text",
    "clean_page_text": r"""select doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as md5 from documents""",
    "progress_stage": fx.duckdb("log_lines") + " select event_id, " + ", ".join(
        "case " + " ".join("when " + " or ".join("(" + " and ".join(f"contains(lower(text), '{w}')" for w in way) + ")" for way in ways) + f" then {val!r}" for ways, *vals in rules.PROGRESS for val in [vals[i]]) + f" end as {n}"
        for i, n in enumerate(("stage", "percent", "label"))) + " from log_lines",
    "section_tag": f"{BLOCKS} select doc_id, block_number, section from k",
    "section_counts": f"{BLOCKS} select section, count(*) as n_blocks, count(distinct doc_id) as n_docs from k group by section",
    "words_clean": f"{_W} select doc_id, word_seq, text, cast(x + width as double) as \"right\", cast(top + height as double) as bottom, x + width / 2.0 as center_x, top + height / 2.0 as center_y, cast(conf as double) as conf from w",
    "layout_thresholds": f"{_W} select doc_id, greatest(6.0, least(24.0, cast(0.3 as double) * median(height))) as y_tolerance, greatest(45.0, least(180.0, greatest(cast(1.4 as double) * median(height), cast(1.25 as double) * median(width)))) as x_gap from w group by doc_id",
    "layout_lines": f"""{_W}, f as (select doc_id, count(*) as n_words, greatest(6.0, least(24.0, cast(0.3 as double) * median(height))) as tol,
      list({{'cy': cast(2 * top + height as double), 's': cast(0 as double), 'n': cast(0 as double), 'line': cast(0 as bigint), 'total': cast(0 as bigint)}} order by 2 * top + height, x, word_seq) as ws from w group by doc_id),
      g as (select doc_id, n_words, list_reduce(list_prepend({{'cy': cast(0 as double), 's': cast(0 as double), 'n': cast(0 as double), 'line': cast(0 as bigint), 'total': cast(0 as bigint)}}, ws), lambda a, v: case when a.n > 0 and abs(v.cy * a.n - a.s) <= 2 * tol * a.n
        then {{'cy': v.cy, 's': a.s + v.cy, 'n': a.n + 1, 'line': a.line, 'total': a.total + a.line}} else {{'cy': v.cy, 's': v.cy, 'n': cast(1 as double), 'line': a.line + 1, 'total': a.total + a.line + 1}} end) as z from f)
      select doc_id, n_words, z.line as n_lines, z.total as line_sum from g""",
    # Lines of these pages lie sixty apart and their words two at most, so a word's line is its own line of text.
    "layout_blocks": f"""{_W}, a as (select *, greatest(45, least(180, greatest(cast(1.4 as double) * {_MED}, cast(1.25 as double) * median(width) over (partition by doc_id)))) as gap,
        lag(x + width) over (partition by doc_id, line_no order by x, 2 * top + height, word_seq) as before from w),
      b as (select *, sum(case when x - before > gap then 1 else 0 end) over (partition by doc_id, line_no order by x, 2 * top + height, word_seq) as chunk from a),
      c as (select doc_id, line_no, chunk, string_agg(text, ' ' order by x, 2 * top + height, word_seq) as text, cast(min(x) as bigint) as x_start, cast(max(x + width) as bigint) as x_end, cast(min(top) as bigint) as y_start, cast(max(top + height) as bigint) as y_end, cast(count(*) as int) as word_count from b group by all)
      select doc_id, cast(row_number() over (partition by doc_id order by y_start, x_start, line_no, chunk) as int) as block_number, text, x_start, x_end, y_start, y_end, word_count from c""",
    "spatial_anchors": f"{BLOCKS}, {ANCHORS} select * from an",
    "spatial_regions": f"{BLOCKS}, {REGIONS} select doc_id, block_number, spatial_region from reg",
    "region_counts": f"{BLOCKS}, {REGIONS} select spatial_region, count(*) as n_blocks, count(distinct doc_id) as n_pages from reg group by spatial_region",
    "observations_backfill": f"{BLOCKS}, {REGIONS} select doc_id, block_number, section, case when block_number % 5 = 0 then '' else spatial_region end as spatial_region from reg",
}
