"""Queries on recognition quality, sources, views and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import layout, quality, readings, views
from ..sources import readers, writers
from . import fixtures as fx
from .q_documents import documents
from .q_documents import _B as _DOCS_SQL


def base(spark: SparkSession, d: str) -> DataFrame:
    return fx.frame(spark, d, "doc_words")


#: A second reading of the same words: shifted, every fifth one reversed, every seventh one missing.
_AGAIN = {"left": "left + 3", "conf": "conf + 10", "text": "if(word_seq % 5 = 0, reverse(text), text)"}
_READ = "word_seq % 7 != 0"


def other(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).where(_READ).select("doc_id", "page_number", *[F.expr(_AGAIN.get(c, c)).alias(c) for c in readings.READ])


def _readings(spark: SparkSession, d: str, *shifts: int) -> DataFrame:
    """The words beside their second reading, once for each shift to the left; all are made of the words in one pass."""
    again = [F.when(F.expr(_READ), readings.word(**_AGAIN | {"left": f"{_AGAIN['left']} - {n}"})).alias(f"w{i}") for i, n in enumerate(shifts, 1)]
    return base(spark, d).select("doc_id", "page_number", readings.word().alias("w0"), *again)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    scored = quality.text_score(_docs(spark, d).select("doc_id", "text"))
    w = base(spark, d)
    words, lines = quality.word_score(w, "doc_id"), quality.layout_score(w, "line_no", "doc_id")
    conf = w.groupBy("doc_id").agg(F.avg(F.col("conf").cast("double")).alias("confidence"))
    return quality.combined(scored.join(words, "doc_id", "left").join(lines, "doc_id", "left").join(conf, "doc_id", "left"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Six candidates for each order, with whole scores."""
    a = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as doc_id", "explode(sequence(0, 5)) as variant_order")
    return a.selectExpr("doc_id", "variant_order", "concat('variant', variant_order) as variant", "double((doc_id * 31 + variant_order * 17) % 89) as score", "double((doc_id * 7 + variant_order * 5) % 97) as confidence", "int((doc_id + variant_order) % 23) as n_words", "double((doc_id * 3 + variant_order) % 10) / 10 as single_ratio", "600 + 100 * variant_order as height", "800 as width")


_4 = "bigint(round({0} * 10000))"

QUERIES = {
    "ocr_quality": lambda s, d: quality.text_score(_docs(s, d)).select("doc_id", F.expr(_4.format("text_score")).alias("score")),
    "ocr_word_score": lambda s, d: quality.word_score(base(s, d), "doc_id").select("doc_id", F.expr(_4.format("word_score")).alias("score")),
    "ocr_layout_score": lambda s, d: quality.layout_score(base(s, d), "line_no", "doc_id").select("doc_id", F.expr(_4.format("layout_score")).alias("score")),
    "ocr_combined_score": lambda s, d: _texts(s, d).select("doc_id", F.expr(_4.format("score")).alias("score")),
    "ocr_best_variant": lambda s, d: quality.best(_variants(s, d), "doc_id").select("doc_id", "variant", F.col("score").cast("long").alias("score")),
    "ocr_retry": lambda s, d: quality.retry(_variants(s, d)).select("doc_id", "variant", "needs_retry"),
    "ocr_choice": lambda s, d: _variants(s, d).groupBy("doc_id").agg(F.max(F.expr("if(variant_order < 3, score, null)")).alias("n"), F.max(F.expr("if(variant_order >= 3, score, null)")).alias("t")).select("doc_id", quality.chosen(F.col("n"), F.col("t")).alias("choice"), quality.accepted(F.col("t"), F.col("n"), -5.0).alias("consensus_ok"), quality.accepted(F.col("t"), F.col("n"), 3.0).alias("enhanced_ok")),
    "ocr_merge_iou_pairs": lambda s, d: quality.duplicates(base(s, d), other(s, d)).select("doc_id", "base_seq", "other_seq"),
    "ocr_consensus": lambda s, d: readings.voted(_readings(s, d, 0, 2)).select("doc_id", F.col("word_seq").cast("int").alias("word_seq"), "text"),
    "ocr_merge": lambda s, d: readings.merged(_readings(s, d, 0)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.length("text")).alias("n_chars")),
    "ocr_reading_lines": lambda s, d: quality.reading_lines(layout.cleaned(base(s, d)).select("doc_id", "page_number", "word_seq", "left", "top", "width", "height", "conf", "text")).groupBy("doc_id").agg(F.max("line").cast("long").alias("n_lines"), F.count(F.lit(1)).alias("n_words")),
    "ocr_reconstruct_spacing": lambda s, d: quality.spaced(base(s, d).withColumnRenamed("line_no", "line")).select("doc_id", F.col("line").cast("long").alias("line"), F.md5("text").alias("md5")),
    "ocr_tiles": lambda s, d: quality.tiles(_variants(s, d).where("variant_order = 0").withColumn("height", F.expr("300 + doc_id % 900"))).select("doc_id", "tile", "y0", "y1"),
    "native_usable": lambda s, d: _docs(s, d).select("doc_id", quality.native_usable(F.col("text")).alias("usable")),
    "page_confidence": lambda s, d: quality.confidence(base(s, d).withColumn("conf", F.expr("conf - 5")), "doc_id").select("doc_id", *[F.expr(_4.format(c)).alias(c) for c in ("all_words", "recognition", "checks")]),
    "confidence_review": lambda s, d: quality.confidence(base(s, d), "doc_id").select("doc_id", F.when(F.col("checks") >= 70, "PASS").otherwise("REVIEW").alias("status")),
    "catalog_recent": lambda s, d: readers.recent(s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as doc_id", "o_orderdate as modified", "case o_orderkey % 4 when 0 then 'INVOICE' when 1 then 'RECEIPT' when 2 then 'UNKNOWN' else 'bank_statement' end as document_type")).select("doc_id", "kind"),
    "download_catalog": lambda s, d: writers.downloads(s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as doc_id", "if(o_orderkey % 3 = 0, 'invoice_output.csv', if(o_orderkey % 3 = 1, 'invoice_data.json', 'page_1.png')) as name")),
    "view_cards": lambda s, d: views.cards(documents(s, d)).where("section in ('seller', 'supply', 'payment')").select("doc_id", "section", "field", "label", "value"),
    "view_products": lambda s, d: views.line_table(documents(s, d), "product").select("doc_id", "n", "description", "net_amount", "hsn"),
    "view_generic_text": lambda s, d: views.generic(_docs(s, d).withColumn("page_number", F.lit(1))).select("doc_id", F.md5("html").alias("md5"), F.col("bytes").cast("long").alias("bytes")),
    "safe_names": lambda s, d: s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as part", "concat(' .', p_name, '/', p_brand, ':', p_type, '. ') as raw").select("part", tx.safe_name(F.col("raw")).alias("name")),
    "run_outcome": lambda s, d: views.outcome(s.read.parquet(f"{d}/orders.parquet").where("o_orderkey is not null").selectExpr("o_orderkey as doc_id", "if(o_orderkey % 10 = 0, 'FAILED', 'OK') as status")).select("status", "n", F.md5("documents").alias("documents")),
}

_W = f"{fx.duckdb('doc_words')}, w as materialized (select * exclude (\"left\"), \"left\" as x from doc_words)"
_O = "o as materialized (select doc_id, word_seq, x + 3 as x, top, width, height, conf + 10 as conf, case when word_seq % 5 = 0 then reverse(text) else text end as text from w where word_seq % 7 <> 0)"
_IOU = "(greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.top + a.height, b.top + b.height) - greatest(a.top, b.top)))"
_SHARE = f"cast({_IOU} as double) / greatest(a.width * a.height + b.width * b.height - {_IOU}, 1)"
_KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')".format
_V = "v as (select o_orderkey as doc_id, unnest(range(0, 6)) as k from orders), va as (select doc_id, k, 'variant' || k as variant, (doc_id * 31 + k * 17) % 89 as score, (doc_id * 7 + k * 5) % 97 as confidence, (doc_id + k) % 23 as n_words, ((doc_id * 3 + k) % 10) / 10.0 as single_ratio, 600 + 100 * k as height from v)"
_TS = r"""ts as (select doc_id, case when c = 0 then 0 else greatest(0, 25 * least(c / 1800, 1) + 20 * least(l / 25, 1) + 25 * a / greatest(c, 1) + 15 * cast(len(list_distinct(list_transform(tk, lambda z: lower(z)))) as double) / n + 15 * least(c / greatest(l, 1) / 80, 1)
    - 18 * least(cast(len(list_filter(tk, lambda z: length(z) = 1)) as double) / n, cast(0.6 as double)) - 12 * least(cast(len(list_filter(tk, lambda z: not regexp_matches(z, '[\p{L}\p{N}]'))) as double) / n, cast(0.4 as double))) end as score
  from (select doc_id, cast(length(t) as double) as c, cast(len(list_filter(string_split(t, chr(10)), lambda z: trim(z) <> '')) as double) as l, cast(length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) as double) as a, tk, cast(greatest(len(tk), 1) as double) as n
    from (select doc_id, trim(coalesce(text, '')) as t, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda z: z <> '') as tk from documents)))"""
_WS = "ws as (select doc_id, cast(0.20 as double) * least(greatest(avg(conf), 0), 100) - 18 * cast(count(*) filter (conf < 40) as double) / count(*) - 12 * cast(count(*) filter (conf < 20) as double) / count(*) as score, avg(cast(conf as double)) as confidence from w group by doc_id)"
_LS = "ls as (select doc_id, least(18, greatest(0, 12 * least(avg(n) / 3, 1) + 6 * cast(count(*) filter (n >= 2) as double) / count(*) - 10 * cast(count(*) filter (n = 1) as double) / count(*))) as score from (select doc_id, line_no, count(*) as n from w where trim(text) <> '' group by all) group by doc_id)"
_R4 = "cast(round(({0}) * 10000) as bigint)".format

ORACLE_SQL = {
    "ocr_quality": f"with {_TS} select doc_id, {_R4('score')} as score from ts",
    "ocr_word_score": f"{_W}, {_WS} select doc_id, {_R4('score')} as score from ws",
    "ocr_layout_score": f"{_W}, {_LS} select doc_id, {_R4('score')} as score from ls",
    "ocr_combined_score": f"{_W}, {_WS}, {_LS}, {_TS} select ts.doc_id, {_R4('greatest(0, ts.score + coalesce(ws.score, 0)) + cast(0.15 as double) * least(coalesce(ws.confidence, 0), 100) + coalesce(ls.score, 0)')} as score from ts left join ws using (doc_id) left join ls using (doc_id)",
    "ocr_best_variant": f"with {_V} select doc_id, arg_max(variant, score * 10 - k) as variant, max(score) as score from va group by doc_id",
    "ocr_retry": f"with {_V} select doc_id, variant, score < 52 or confidence < 48 or n_words < 8 or single_ratio > 0.35 or greatest(height, 800) < 1000 as needs_retry from va",
    "ocr_choice": f"with {_V}, m as (select doc_id, max(score) filter (k < 3) as n, max(score) filter (k >= 3) as t from va group by doc_id) select doc_id, case when t > n + 2 then 'targeted' else 'normal' end as choice, t >= n - 5 as consensus_ok, t >= n + 3 as enhanced_ok from m",
    "ocr_merge_iou_pairs": f"{_W}, {_O} select a.doc_id, a.word_seq as base_seq, b.word_seq as other_seq from (select *, unnest([cast(floor(top / 31) as bigint) - 1, cast(floor(top / 31) as bigint), cast(floor(top / 31) as bigint) + 1]) as band from w) a join (select *, cast(floor(top / 31) as bigint) as band from o) b on a.doc_id = b.doc_id and a.band = b.band and b.top between a.top - 30 and a.top + 30 and b.x < a.x + a.width and a.x < b.x + b.width where {_SHARE} >= 0.78 or ({_SHARE} >= 0.45 and {_KEY('a.text')} = {_KEY('b.text')})",
    # Words of one line do not touch, so a word meets its own second reading only.
    "ocr_consensus": f"{_W} select doc_id, word_seq, case when word_seq % 7 = 0 or word_seq % 5 <> 0 or {_KEY('text')} = {_KEY('reverse(text)')} or {_KEY('text')} = '' then text else reverse(text) end as text from w",
    "ocr_reconstruct_spacing": f"""{_W}, u as (select *, greatest(3, median(width) over (partition by doc_id) / 5) as unit, max(x + width) over (partition by doc_id, line_no order by x, word_seq rows between unbounded preceding and 1 preceding) as before from w),
      p as (select doc_id, line_no, x, word_seq, case when before is null then '' else repeat(' ', cast(least(8, greatest(1, round_even(greatest(0, x - before) / unit, 0))) as int)) end || trim(text) as piece from u) select doc_id, line_no as line, md5(string_agg(piece, '' order by x, word_seq)) as md5 from p group by all""",
    "ocr_tiles": "with h as (select o_orderkey as doc_id, 300 + o_orderkey % 900 as h from orders), t as (select doc_id, h, cast(unnest(range(0, 4)) as int) as tile from h where h >= 400) select doc_id, tile, cast(greatest(0, floor(tile * (h / 4) - 0.12 * (h / 4))) as int) as y0, cast(least(h, ceil((tile + 1) * (h / 4) + 0.12 * (h / 4))) as int) as y1 from t",
    "native_usable": r"select doc_id, length(t) >= 80 and len(list_filter(string_split(t, chr(10)), lambda z: trim(z) <> '')) >= 2 and length(regexp_replace(t, '\s+', '', 'g')) >= 60 as usable from (select doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from documents)",
    "page_confidence": f"{_W} select doc_id, {_R4('avg(cast(conf - 5 as double))')} as all_words, coalesce({_R4('avg(cast(conf - 5 as double)) filter (conf >= 5)')}, 0) as recognition, {_R4('avg(cast(conf - 5 as double)) filter (conf between 5 and 105)')} as checks from w group by doc_id",
    "confidence_review": f"{_W} select doc_id, case when avg(conf) >= 70 then 'PASS' else 'REVIEW' end as status from w group by doc_id",
    "catalog_recent": "select o_orderkey as doc_id, case o_orderkey % 4 when 0 then 'Invoice' when 1 then 'Receipt' when 2 then 'Document' else 'Bank Statement' end as kind from orders order by o_orderdate desc, o_orderkey limit 5",
    "download_catalog": "select o_orderkey as doc_id, a as artifact, a = case o_orderkey % 3 when 0 then 'invoice_output.csv' when 1 then 'invoice_data.json' else '' end as there from orders, (select unnest(['generic_final.json', 'final_invoice_data.json', 'invoice_data.json', 'invoice_output.csv', 'invoice_output.xlsx', 'validation_report.json']) as a)",
    "view_cards": f"""{_DOCS_SQL}, c as (select doc_id, unnest([{{'section': 'seller', 'field': 'name', 'value': seller_name}}, {{'section': 'seller', 'field': 'address', 'value': seller_address}}, {{'section': 'seller', 'field': 'pan', 'value': pan}}, {{'section': 'seller', 'field': 'gstin', 'value': gstin}},
      {{'section': 'supply', 'field': 'place_of_supply', 'value': place_of_supply}}, {{'section': 'supply', 'field': 'place_of_delivery', 'value': place_of_delivery}}, {{'section': 'payment', 'field': 'transaction', 'value': payment_id}}, {{'section': 'payment', 'field': 'mode', 'value': payment_mode}},
      {{'section': 'payment', 'field': 'value', 'value': case when payment_value_c is not null then cast(payment_value_c // 100 as varchar) || '.' || lpad(cast(payment_value_c % 100 as varchar), 2, '0') end}}]) as r from dx)
      select doc_id, r.section, r.field, array_to_string(list_transform(string_split(r.field, '_'), lambda z: upper(z[1]) || z[2:]), ' ') as label, r.value from c where trim(r.value) <> ''""",
    "view_products": f"{_DOCS_SQL} select doc_id, cast(row_number() over (partition by doc_id order by row_number) as int) as n, description, cast(net_c // 100 as varchar) || '.' || lpad(cast(net_c % 100 as varchar), 2, '0') as net_amount, hsn from it where item_type = 'product'",
    "view_generic_text": r"select doc_id, md5(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as md5, cast(b as bigint) as bytes from (select doc_id, strlen(text) as b, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from documents)",
    "safe_names": r"""select p_partkey as part, regexp_replace(replace(replace(' .' || p_name || '/' || p_brand || ':' || p_type || '. ', '/', '_'), ':', '_'), '^[ .]+|[ .]+$', '', 'g') as name from part""",
    "run_outcome": "select status, count(*) as n, md5(string_agg(cast(k as varchar), ', ' order by cast(k as varchar))) as documents from (select o_orderkey as k, case when o_orderkey % 10 = 0 then 'FAILED' else 'OK' end as status from orders) group by status",
}
