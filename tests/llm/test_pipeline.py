"""The pipeline, stage by stage, on its own tables."""

from foliant.llm import common
import corpus_pipeline
from tests.llm.conftest import prose


def test_stages_in_order(spark, tmp_path, rows):
    item = prose(700, 40)
    leaked = (50, prose(701, 60) + " " + item, "en", "src0")
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([*rows, leaked], schema).selectExpr("*", "length(text) as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = f"{tmp_path}"
    docs = common.read(spark, d, "documents")
    columns, held = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.stored(stage(spark, docs, d), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        held.append({r.doc_id for r in out.collect()})
        docs = out
    kept, single, clean, mixed, sharded = held
    assert 50 in kept and 27 not in kept and 24 not in kept
    assert 20 in single and 21 not in single and 22 not in single
    assert clean == single - {50} and mixed <= clean and sharded == mixed
    ran = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, ran.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_components_of_long_chains(spark):
    edges = spark.range(400).selectExpr("id as a", "id + 1 as b").unionAll(spark.range(1000, 1010).selectExpr("id as a", "2000 as b"))
    got = common.components(edges, "chain").collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(401)} | {(i, 1000) for i in [*range(1000, 1010), 2000]}
    assert common.components(edges.limit(0), "none").count() == 0
