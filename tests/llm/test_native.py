"""Personal data, quality rules, mixing and sharding."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from foliant.llm import mixing, pii, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_duckdb(rows, sql):
    import pandas as pd

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", [list(r) for r in rows])
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    return Counter(tuple(x[names.index(n)] for n in sorted(names)) for x in r.fetchall())


def collected(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_quality_agrees_with_sql(docs, rows):
    unique = [r for r in rows if r[0] not in (33, None)]
    got = collected(quality.assess(docs.where("doc_id != 33")))
    assert got == in_duckdb(unique, quality.ORACLE_SQL)


def test_quality_keeps_prose_and_own_columns(docs, empty):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {20, 21, 22, 30} | set(range(12)) <= ids
    assert not ids & {24, 25, 26, 27, 28, 29}
    assert quality.assess(empty).count() == 0 and quality.keep(empty).count() == 0


def test_quality_stores_no_texts(docs, monkeypatch):
    tables, store = [], quality.stored
    monkeypatch.setattr(quality, "stored", lambda df, name: tables.append(df.columns) or store(df, name))
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    assert kept == {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    assert tables and not any({"doc", "text"} & set(c) for c in tables)


def test_pii_spans(spark):
    texts = [
        (1, "mail bob.x@mail1.example.com, card 4111 1111 1111 1111 or 4111111111111112; ip 10.0.0.255 and 10.0.0.256"),
        (2, "call +1 (234) 555-6789 now. +12 no. é+1 (974) 555-3436"),
        (3, "iban account GB82WEST12345698765432 and GB82WEST12345698765433; ssn 123-45-6789"),
        (4, None), (5, ""), (6, "a@b.c_x@d.e " * 300), (7, "1" * 5000 + "@" + "1.1.1.1" * 500), (8, "123-45-6789"),
    ]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 0)
    assert got[2].n_phone == 2 and "phone:" in got[2].spans
    assert got[3].spans.startswith("iban:13:35") and "ssn" in got[3].spans and got[3].n_card == 0
    assert got[8].spans == ""  # no context, no score
    assert got[4].base_sha256 == got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[6].n_email == 600
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for i, t in texts:
        found = [f"email:{m.start()}:{m.end()}" for m in email.finditer(t or "")]
        assert [s for s in got[i].spans.split(",") if s.startswith("email")] == found
    sql = in_duckdb([(i, t, None, None) for i, t in texts if i != 7], pii.ORACLE_SQL)
    assert collected(pii.digest(spark.createDataFrame([x for x in texts if x[0] != 7], "doc_id long, text string"))) == sql


def test_pii_masks(spark, docs, empty):
    masked = pii.masked(spark.createDataFrame([(1, "é a@b.c, +1 (234) 555-6789!"), (2, None), (3, "plain")], "doc_id long, text string")).collect()
    assert [r.text for r in sorted(masked)] == ["é <email>, <phone>!", None, "plain"]
    assert pii.digest(docs).count() == docs.count() and pii.digest(empty).count() == 0


def test_mixing_reaches_targets(docs, rows, empty):
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixture(docs.repartition(5)).collect()), key=repr)
    size = {r.doc_id: r.size for r in got}
    sources = defaultdict(int)
    for _, text, _, source in rows:
        sources[source] += len(WORD.findall(text or ""))
    total, order = sum(sources.values()), sorted(sources, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, fixed = {}, set()
    while True:
        left = 1.5 * total - sum(2.0 * sources[s] for s in fixed)
        free = [s for s in order if s not in fixed]
        target = {s: 2.0 * sources[s] if s in fixed else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 2 * sources[s]}
        if not over:
            break
        fixed |= over
    source_of = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sources[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in order:
        largest = max((n for i, n in size.items() if source_of[i] == s), default=0)
        assert abs(taken[s] - target[s]) <= largest + 1e-6
    assert mixing.mixture(empty).count() == 0


def test_mixing_many_levels(spark):
    rows = spark.range(20000).selectExpr("id", "if(id % 3 = 0, 'b', 'a') as source", "1 + id % 50 as size")
    got = mixing.mix(rows).groupBy("source").agg({"target": "max", "size": "sum"}).collect()
    sums = {r.source: r for r in mixing.mix(rows).selectExpr("source", "target", "copies * size as t").groupBy("source").sum("t").collect()}
    for r in got:
        assert abs(sums[r.source]["sum(t)"] - r["max(target)"]) <= 50


def test_mixed_documents(docs, empty):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    plan = {r.doc_id: (r.taken // r.size if r.size else 0) for r in mixing.mix(docs.selectExpr("struct(doc_id, 0 as z) as id", "source", "1L as size")).selectExpr("id.doc_id", "size", "copies * size as taken").collect()}
    assert set(r.doc_id for r in out.collect()) <= set(plan)
    assert mixing.mixed(empty).count() == 0


def test_shards_fit(docs, rows, empty):
    limit = 6000
    got = sharding.sharded(docs, limit).collect()
    assert len(got) == len(rows)
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r)
    for shard, members in held.items():
        total = sum(m.n_bytes for m in members)
        assert total == members[0].shard_bytes and len(members) == members[0].shard_docs
        assert total <= limit or len(members) == 1
    names = [s.split("-")[0] for s in held]
    for a in names:
        assert not any(b != a and b.startswith(a) for b in names)
    assert sharding.sharded(empty, limit).count() == 0


def test_shards_of_equal_rows(spark):
    rows = spark.range(100).selectExpr("7 as id", "100L as bytes")
    got = sharding.directory(sharding.shards(rows, 1000)).collect()
    assert sorted(r.n_bytes for r in got) == [1000] * 10
    many = spark.range(3000).selectExpr("id", "100L as bytes").unionAll(rows.selectExpr("cast(id as long)", "bytes"))
    assert max(r.n_bytes for r in sharding.directory(sharding.shards(many, 1000)).collect()) <= 1000


def test_pii_in_dense_long_texts(spark):
    """Thousands of spans in one text, contexts over the edges of pieces and characters of several bytes."""
    texts = [(1, "1." * 20000), (2, "é€ a@b.c mail 10.0.0.1 " * 3000), (3, "x" * 230 + " ip " + "y" * 20 + " 10.0.0.1 " + "z" * 30 + " host"), (4, "\U0001f600" * 300 + " ssn 123-45-6789 " + "\U0001f600" * 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert (got[1].n_ip, got[2].n_email, got[2].n_ip) == (5000, 3000, 3000) and got[4].spans == "ssn:305:316"
    assert collected(pii.digest(df.where("doc_id != 1"))) == in_duckdb([(i, t, None, None) for i, t in texts if i != 1], pii.ORACLE_SQL)


def test_fences_follow_each_group(spark):
    """A source of alike documents keeps all of them; one that varies more has a wider fence; a lone document borrows its language's."""
    def text(i, symbols):
        words = [f"word{i}x{k}" for k in range(60)]
        return " ".join(w + "#" * (k < symbols) for k, w in enumerate(words))

    rows = [(i, text(0, 30), "en", "alike") for i in range(120)]
    rows += [(1000 + i, text(i, i % 3), "en", "narrow") for i in range(200)] + [(2000 + i, text(i, i % 25), "en", "wide") for i in range(200)]
    rows += [(3000, text(1, 58), "en", "narrow"), (3001, text(1, 58), "en", "lone"), (3002, text(2, 1), "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.assess(df).where("kept").collect()}
    assert kept == {r[0] for r in rows} - {3000}
    by = {r.source: r.f for r in quality.fences(quality.sketches(quality.counts(quality._named(df), quality.F.col("doc.text")))).collect()}
    assert by["narrow"].symbols < by["wide"].symbols and len({f.symbols for f in by.values()}) == len(by)
    assert collected(quality.assess(df)) == in_duckdb(rows, quality.ORACLE_SQL)
