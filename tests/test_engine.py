"""Rules that decide results, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import classify, fields, integrate, layout, quality, spatial, tables, validate
from foliant.plans import catalogue, fixtures
from foliant.sources import readers


def one(spark, **columns):
    """The values of expressions over one row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_every_query_has_a_name_and_most_a_twin():
    assert len(catalogue.QUERIES) >= 90
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert len(catalogue.ORACLE_SQL) >= len(catalogue.QUERIES) - 8


def test_text_rules(spark):
    t = F.lit
    r = one(
        spark, cut=tx.field_amounts(t("1234.50")), whole=tx.table_amounts(t("1234.50 -1,200.00")), qty=tx.quantity_tokens(t("a 3 % b 12")), folded=tx.folded(t(" N/A ")), kept=tx.folded(t(" x ")), pct=tx.percentage(t("9%/9%")),
        number=tx.number(t("₹1,234.5")), none=tx.number(t("12x")), pan=tx.valid_pan(t("abcde1234f")), newline=tx.valid_hsn(F.lit("1234").cast("string")), odd=tx.valid_hsn(t("1234x")), name=tx.safe_name(t(" a/b:c. ")), empty=tx.safe_name(t("")),
        charger=tables.charge_class(t("phone charger"))[1], coffee=tables.charge_class(t("coffee"))[0], cash=tables.charge_class(t("cash on delivery"))[1], subtotal=fields.label_of_total(t("Subtotal 5")), total=fields.label_of_total(t("Total 5")),
        tax=fields.label_of_total(t("total taxes")), words=tables.in_words(t("One hundred and two only")), header=tables.is_header(t("Qty Price")), section=layout.section(t("Total Amount in Words")), hsn=tables.hsn(t("HSN: 123456")),
        near=tx.near(t(1.0), t(1.01)), far=tx.near(t(1.0), F.lit(None).cast("double")),
    )
    assert list(r.cut) == ["234.50"] and list(r.whole) == ["1234.50", "-1200.00"] and list(r.qty) == [12]
    assert r.folded is None and r.kept == "x" and r.pct == 9.0 and r.number == 1234.5 and r.none is None
    assert r.pan and r.newline and not r.odd and (r.name, r.empty) == ("a_b_c", "document")
    assert (r.charger, r.coffee, r.cash) == ("Fee", "charge", "COD Fee")
    assert not r.subtotal and r.total and not r.tax and r.words and r.header and r.section == "PRODUCT_TABLE" and r.hsn == "123456"
    assert r.near and not r.far


def test_classes(spark):
    rows = [(1, "TOTAL"), (2, "Tax Invoice\nInvoice Number 1\nGSTIN\nHSN"), (3, None), (4, "invoice sold by amazon.in"), (5, "amazon resume")]
    got = {r.doc_id: r for r in classify.routed(classify.classified(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (got[1].document_type, got[1].confidence) == ("UNKNOWN", 0) and got[3].document_type == "UNKNOWN"
    assert got[2].document_type == "INVOICE" and got[2].confidence == 95 and got[2].route_batch == "generic"
    assert got[4].route_batch == "structured" and got[5].route_upload == "generic"


def test_words_become_blocks(spark):
    words = [(1, 1, 1, "a", 10.0, 100.0, 30.0, 20.0), (1, 1, 2, "b", 50.0, 101.0, 30.0, 20.0), (1, 1, 3, "c", 400.0, 100.0, 30.0, 20.0), (1, 1, 4, "d", 10.0, 160.0, 30.0, 20.0), (1, 2, 1, "e", 10.0, 100.0, 30.0, 20.0), (1, 2, 2, " ", 1.0, 1.0, 1.0, 1.0), (1, 2, 3, "z", -1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(words, "doc_id long, page_number int, word_seq int, text string, left double, top double, width double, height double")
    cleaned = layout.cleaned(df)
    got = [(r.page_number, r.block_number, r.text, r.word_count) for r in layout.blocks(cleaned).orderBy("page_number", "block_number").collect()]
    assert got == [(1, 1, "a b", 2), (1, 2, "c", 1), (1, 3, "d", 1), (2, 1, "e", 1)]
    assert layout.blocks(cleaned.limit(0)).count() == 0


def test_fold_of_lines_agrees_with_a_plain_loop(spark):
    import random

    draw = random.Random(4)
    words = [(d, 1, i, "w", float(draw.randrange(900)), float(draw.randrange(300)), 30.0, 20.0) for d in range(3) for i in range(1, 700)]
    df = spark.createDataFrame(words, "doc_id long, page_number int, word_seq int, text string, left double, top double, width double, height double")
    got = {(r.doc_id, r.word_seq): r.line for r in layout.lines(layout.cleaned(df)).collect()}
    for d in range(3):
        page = sorted((w[5] + w[7] / 2, w[4], w[2]) for w in words if w[0] == d)
        line, total, n = 0, 0.0, 0
        for cy, _, seq in page:
            if n and abs(2 * cy * n - total) <= 2 * 6.0 * n:
                total, n = total + 2 * cy, n + 1
            else:
                line, total, n = line + 1, 2 * cy, 1
            assert got[(d, seq)] == line


def test_regions_without_anchors_are_empty(spark):
    rows = [(1, 1, 1, "hello", 0, 10, 0, 10), (1, 1, 2, "world", 0, 10, 20, 30), (2, 1, 1, "Payment Transaction ID: X", 0, 10, 0, 10), (2, 1, 2, "later", 0, 10, 50, 60)]
    df = layout.sectioned(spark.createDataFrame(rows, "doc_id long, page_number int, block_number int, text string, x_start int, x_end int, y_start int, y_end int"))
    got = {(r.doc_id, r.block_number): r.spatial_region for r in spatial.assigned(df).collect()}
    assert got == {(1, 1): "", (1, 2): "", (2, 1): "PAYMENT", (2, 2): "PAYMENT"}


@pytest.mark.parametrize("observed, products, charges, total, how", [
    (130.0, [60.0, 40.0], [], 130.0, "document_level_observation_with_additional_components"), (7.0, [], [20.0, 5.0], 25.0, "sum_of_charge_totals"), (100.0, [60.0, 40.0], [9.0], 100.0, "validated_product_total_sum"),
    (None, [60.0], [], 60.0, "sum_of_product_totals"), (5.0, [], [], 5.0, "field_extractor_observation"),
])
def test_totals_are_resolved(spark, observed, products, charges, total, how):
    part = lambda xs: "cast(array(" + ", ".join(f"named_struct('total_amount_value', {x}D)" for x in xs) + ") as array<struct<total_amount_value: double>>)"
    df = spark.sql(f"select 1 as doc_id, cast({'null' if observed is None else observed} as double) as observed_total, {part(products)} as items, {part(charges)} as charges")
    r = integrate.resolved(df).first()
    assert (r.total_amount, r.total_resolution) == (total, how)


def test_rows_without_page_go_to_the_only_document(spark):
    fields_ = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "doc_id long, page int")
    rows = integrate.conform(spark.createDataFrame([(1, " N/A ", "product", "5"), (2, "none", "product", "5")], "doc_id long, page string, type string, total string"))
    got = {(r.doc_id, r.page): r.table_product_count for r in integrate.attached(fields_, rows).collect()}
    assert got == {(1, 1): 1, (2, 1): 0, (2, 2): 0}


def test_taxes_of_two_parts_pass(spark):
    item = "named_struct('description', 'x', 'quantity', '1', 'unit_price', '100', 'net_amount', '100', 'tax_rate', '9%/9%', 'tax_type', 'CGST/SGST', 'tax_amount', '18', 'total_amount', '118', 'asin', 'B000000001', 'hsn', '1234')"
    got = {r.c.check: r.c.status for r in spark.sql(f"select {item} as p").select(F.explode(validate.product(F.col("p"), F.lit(0))).alias("c")).where("c is not null").collect()}
    assert got["product_1.tax_calculation"] == got["product_1.total_calculation"] == got["product_1.net_calculation"] == "PASS"


def test_readings_are_merged(spark):
    schema = "doc_id long, page_number int, word_seq long, left double, top double, width double, height double, conf double, text string"
    base = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 100.0, 20.0, 50.0, "total"), (1, 1, 2, 200.0, 0.0, 100.0, 20.0, 90.0, "sum")], schema)
    other = spark.createDataFrame([(1, 1, 1, 1.0, 0.0, 100.0, 20.0, 60.0, "Total"), (1, 1, 2, 201.0, 0.0, 100.0, 20.0, 92.0, "sun"), (1, 1, 3, 500.0, 0.0, 10.0, 20.0, 80.0, "new")], schema)
    got = [(r.word_seq, r.text) for r in quality.merged(base, other).orderBy("word_seq").collect()]
    assert got == [(1, "Total"), (2, "sum"), (3, "new")]
    voted = {r.word_seq: r.text for r in quality.consensus(base, other, other).collect()}
    assert voted[1] == "total" and voted[2] == "sun"


def test_files_and_engines(spark, tmp_path):
    for name in ("B.PDF", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in readers.listing(spark, str(tmp_path)).collect()] == ["a.png", "B.PDF"]
    words = readers.recognised(readers.inputs(spark, str(tmp_path)).selectExpr("doc_id", "1 as page_number", "content as image"), lambda image: iter([{"text": "hi", "left": 1.0}]))
    assert [(r.text, r.error) for r in words.collect()] == [("hi", None)] * 2
    failed = readers.recognised(readers.inputs(spark, str(tmp_path)).selectExpr("doc_id", "1 as page_number", "content as image"))
    assert all(r.error for r in failed.collect())
    assert readers.optional(spark, str(tmp_path / "none.csv"), readers.BLOCKS).count() == 0


def test_stream_of_documents(spark, tmp_path):
    from foliant.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Tax Invoice\nInvoice Number 5")
    seen = []
    ingest.run(ingest.classified(ingest.landing(spark, str(tmp_path / "in"))), lambda df, i: seen.extend(r.document_type for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == ["INVOICE"]


def test_messages_of_all_checks(spark):
    d = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["validate_messages"](spark, d).collect()
    checks = catalogue.QUERIES["export_sheet_validation"](spark, d).select("doc_id", "check").collect()
    assert sorted((r.doc_id, r.check) for r in got) == sorted(map(tuple, checks))
    assert any(r.message for r in got)


def test_blocks_are_made_after_the_only_shuffle(spark):
    plan = fixtures.frame(spark, "/root/testdata/sf0.001", "inv_blocks")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_observations_of_some_regions_lose_no_page(spark):
    rows = [(1, 1, 1, "Order Number: A-1", "ORDER"), (1, 1, 2, "x", "SELLER"), (2, 1, 1, "y", "SELLER")]
    a = spark.createDataFrame(rows, "doc_id long, page_number int, block_number int, text string, section string")
    a = a.selectExpr("*", "10 * block_number as y_start", "10 * block_number + 5 as y_end", "0 as x_start", "9 as x_end", "'' as spatial_region")
    got = fields.observed(a, names=["ORDER"]).select("doc_id", F.expr("transform(obs, o -> o.text)").alias("t"), fields.order()["number"].alias("number")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.t, r.number) for r in got] == [(1, ["Order Number: A-1"], "A-1"), (2, [], "")]


def test_amounts_are_those_of_items(spark):
    rows = [(1, "Blue widget", 100, 600, 1000), (2, "10.00", 900, 1000, 1000), (3, "IGST 5%", 1300, 1400, 1000), (4, "0.50", 1450, 1550, 1000), (5, "10.50", 1700, 1900, 1000), (6, "TOTAL:", 100, 250, 1200), (7, "10.50", 1700, 1900, 1200)]
    a = spark.createDataFrame(rows, "block_number int, text string, x_start int, x_end int, y_start int")
    a = a.selectExpr("1L as doc_id", "1 as page_number", "*", "y_start + 30 as y_end", "if(block_number < 6, 'PRODUCT_TABLE', 'TOTAL') as spatial_region")
    columns = ["unit_price", "net_amount", "tax_rate", "tax_type", "tax_amount", "total_amount"]
    (got,) = tables.amounts(a).select(*columns).collect()
    assert tuple(got) == ("10.00", "10.00", "5%", "IGST", "0.50", "10.50")
    assert [got] == tables.items(a).select(*columns).collect()


def test_tall_boxes_overlap(spark):
    row = "doc_id long, page_number int, word_seq long, left long, top long, width long, height long, text string, conf long"
    base = spark.createDataFrame([(1, 1, 1, 0, 0, 3000, 900, "a", 50), (1, 1, 2, 5000, 0, 10, 10, "b", 50), (None, 1, 3, 0, 0, 3000, 900, "a", 50)], row)
    other = spark.createDataFrame([(1, 1, 1, 0, 170, 3000, 900, "a", 50), (1, 1, 2, 5005, 5, 10, 10, "b", 50), (1, 2, 3, 0, 0, 3000, 900, "a", 50)], row)
    assert sorted((r.base_seq, r.other_seq) for r in quality.overlaps(base, other).collect()) == [(1, 1), (2, 2)]
    assert [(r.base_seq, r.other_seq) for r in quality.duplicates(base, other).collect()] == [(1, 1)]


def _plan(spark, name):
    return catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_observations_are_made_after_the_only_shuffle(spark):
    assert _plan(spark, "observations_once").count("Exchange hashpartitioning") == 1


def test_totals_need_no_window_over_blocks(spark):
    assert "Window" not in _plan(spark, "field_total_proximity")


def test_sheet_makes_no_messages(spark):
    assert "Invoice number found" in _plan(spark, "validate_messages")
    assert "Invoice number found" not in _plan(spark, "export_sheet_validation")


def _inferring(df):
    """Generators from which the optimizer infers a filter that works out their array once more: those of a column that are not outer."""
    found, left = [], [df._jdf.queryExecution().analyzed()]
    while left:
        node = left.pop()
        left += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate" and not node.outer() and node.generator().children().head().getClass().getSimpleName() == "AttributeReference":
            found.append(node.generator().toString())
    return found


def test_rows_of_pages_make_their_array_once(spark):
    a = spark.range(1, 3).selectExpr("id as doc_id", "1 as page_number", "filter(array(struct(string(id) as text), struct(null as text)), x -> id = 1) as blocks")
    rows = layout.unpaged(a.withColumn("blocks", F.transform("blocks", lambda x: F.struct(F.concat(x["text"], F.lit("marked")).alias("text")))))
    assert [tuple(r) for r in rows.collect()] == [(1, 1, "1marked"), (1, 1, None)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("marked") == 1


@pytest.mark.parametrize("name", ["row_quantity", "row_neighbors", "money_roles", "row_discount", "total_nearest", "identifier_nearest", "export_sheet_validation", "end_to_end", "observations_backfill", "items_description"])
def test_arrays_are_made_once(spark, name):
    assert _inferring(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")) == []


def test_blocks_of_a_table_are_sorted_once(spark):
    a = spark.range(2).selectExpr("id as doc_id", "1 as page_number", "id as block_number", "'x' as text", "1 as x_start", "2 as x_end", "1 as y_start", "2 as y_end", "if(id = 0, 'PRODUCT_TABLE', null) as spatial_region")
    pages = tables.pages(a, tables.STARTS)
    assert [r.doc_id for r in pages.collect()] == [0]
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("sort_array(") == 1


def _outer_lambda_arrays(df, name):
    """How many arrays the projection that makes column `name` makes, those within lambdas included."""
    line = next(x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if f" AS {name}#" in x)
    return line.count("transform(")


def test_a_region_is_found_without_the_page_for_each_block(spark):
    a = spark.range(1).selectExpr("id as doc_id", "1 as page_number", "array(struct(id as block_number, string(id) as text, id as x_start, id as x_end, id as y_start, '' as section)) as blocks")
    assert _outer_lambda_arrays(spatial.assigned_pages(a), "blocks") == 1


def test_a_neighbour_is_found_without_the_row_for_each_block(spark):
    x = "struct(id as b, double(id) as y0, double(id) as y1)"
    a = spark.range(1).selectExpr("id as doc_id", f"array({x}) as own", f"array({x}, struct(id + 1 as b, double(id) as y0, double(id) as y1)) as `all`")
    rows = tables.with_neighbours(a.repartition(1))
    assert _outer_lambda_arrays(rows.selectExpr("doc_id", "near"), "near") == 0
    assert [len(r.near) for r in rows.collect()] == [1]


def test_rates_of_a_row_are_gathered_once(spark):
    plan = catalogue.QUERIES["money_roles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(rates#" in plan and "exists(flatten(" not in plan
