"""Quality rules: fixed base rules, then fences that adapt to each language and source.

Fences come from mergeable quantile sketches: log-linear histograms of integer ratios (32 buckets to each power of two, so
a quantile is off by 1/32 at most). Sketches of sources merge into one of their language, those into one of all rows, by
adding counts. A sketch gives the median, the spread (the mean distance from the median) and the outer deciles; the fence stands some spreads (SPREADS) from
the median and never within the deciles of a group that is large enough to know them. No cutoff is fixed: where a source's documents vary more, its fence lies further out. Fences of a
group are weighted with those of the next larger one as if that had given SHRINK documents, so small groups borrow.

Defined results: a null or empty text has no words, so it fails the base rules; null language or source is a group like
any other; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, stored, words_of

#: What the fence of the next larger group weighs, in documents; a group of fewer may lie outside its own deciles.
SHRINK = 50
#: Ratio -> spreads between the median and its fence. Repeated lines and words come in long natural tails, the others do not.
SPREADS = {"symbols": 8, "dup_lines": 24, "repeats": 24, "word_length": 8}

_RATIOS = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "word_length": "1000 * word_chars div greatest(n_words, 1)",
}


def counts(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the struct `q`: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed. No shuffle, no Python."""
    text = F.coalesce(text, F.lit(""))
    a = rows.withColumns({"q_text": text, "q_words": words_of(text)})
    a = a.withColumns({
        "q_lines": F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "q_grams": F.expr("if(size(q_words) < 5, cast(array() as array<bigint>), transform(sequence(0, size(q_words) - 5), i -> xxhash64(q_words[i], q_words[i + 1], q_words[i + 2], q_words[i + 3], q_words[i + 4])))"),
    })
    a = a.withColumn("q_sorted", F.expr("if(size(array_distinct(q_grams)) = size(q_grams), null, array_sort(transform(q_grams, (h, i) -> struct(h as h, i as i))))"))
    a = a.withColumn("q_twice", F.expr("if(q_sorted is null, null, array_sort(transform(filter(transform(q_sorted, (x, k) -> if(x.h <=> get(q_sorted, k - 1).h or x.h <=> get(q_sorted, k + 1).h, x.i, null)), x -> x is not null), x -> x)))"))
    repeats = F.expr("if(q_twice is null, 0L, aggregate(transform(q_twice, (x, k) -> bigint(least(5, coalesce(get(q_twice, k + 1) - x, 5)))), 0L, (s, x) -> s + x))")
    a = a.withColumn("q", F.struct(
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("q_lines").cast("long").alias("n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    )).drop("q_text", "q_words", "q_lines", "q_grams", "q_sorted", "q_twice")
    return a.withColumn("q", F.col("q").withField("base_failed", F.expr("q.n_words < 10 or 100 * q.n_repeat_words > 20 * q.n_words")))


def sketches(rows: DataFrame) -> DataFrame:
    """From rows (lang, source, q): (metric, lang, source, v, c), c rows of a group in the bucket that begins at v."""
    ok = rows.where("not q.base_failed").select("lang", "source", "q.*")
    tall = ok.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.expr(e).alias("x")) for k, e in _RATIOS.items()])).alias("m"))
    bucket = F.expr("if(m.x < 32, m.x, shiftleft(shiftright(m.x, length(bin(m.x)) - 6), length(bin(m.x)) - 6))")
    return tall.select("lang", "source", "m.metric", bucket.alias("v")).groupBy("metric", "lang", "source", "v").agg(F.count(F.lit(1)).alias("c"))


def _summaries(sketch: DataFrame, *by: str) -> DataFrame:
    """Merges a sketch into groups: (metric, *by, n, high, low, f, g), the outer deciles of each group and its upper and lower fence before weighting."""
    merged = sketch.groupBy("metric", *by, "v").agg(F.sum("c").alias("c"))
    group = f"partition by {', '.join(('metric', *by))}"
    sums = merged.selectExpr("*", f"sum(c) over ({group} order by v) as upto", f"sum(c) over ({group}) as n")
    sums = sums.selectExpr("*", f"min(if(2 * upto >= n, v, null)) over ({group}) as q50")
    edge = "if(v < 32, v, v + shiftleft(1L, length(bin(v)) - 6) - 1)"
    read = sums.groupBy("metric", *by).agg(
        F.max("n").alias("n"), F.max("q50").alias("q50"), F.sum(F.expr("c * abs(v - q50)")).alias("far"),
        F.min(F.expr(f"if(10 * upto >= 9 * n, {edge}, null)")).alias("high"), F.min(F.expr("if(10 * upto >= n, v, null)")).alias("low"),
    )
    away = "case metric " + " ".join(f"when '{k}' then {v}" for k, v in SPREADS.items()) + " end * far div n"
    return read.selectExpr("metric", *by, "n", "high", "low", f"greatest(high, q50 + {away}) as f", f"least(low, greatest(0L, q50 - {away})) as g")


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, f): f holds the upper fence of each ratio, and the lower one of word length."""
    own, lang, every = _summaries(sketch, "lang", "source"), _summaries(sketch, "lang"), _summaries(sketch)
    both = own.alias("o").join(lang.alias("l"), F.expr("o.metric = l.metric and o.lang <=> l.lang")).join(every.alias("e"), F.expr("o.metric = e.metric"))
    held = lambda a, n, x: f"(({n}) * ({a}) + {SHRINK} * ({x})) div (({n}) + {SHRINK})"
    up, down = (held(f"o.{c}", "o.n", held(f"l.{c}", "l.n", f"e.{c}")) for c in "fg")
    each = both.selectExpr("o.lang", "o.source", "o.metric", f"greatest({up}, if(o.n >= {SHRINK}, o.high, 0L)) as f", f"if(o.n >= {SHRINK}, least({down}, o.low), {down}) as g")
    one = lambda k: F.max(F.expr(f"if(metric = '{k}', f, null)"))
    return each.groupBy("lang", "source").agg(F.struct(*[one(k).alias(k) for k in SPREADS], F.max(F.expr("if(metric = 'word_length', g, null)")).alias("shortest")).alias("f"))


def judged(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Adds `kept` to rows (lang, source, q): whether each passes the base rules and its group's fences, which come from the rows `seen`, else from rows."""
    f = stored(fences(sketches(rows if seen is None else seen)), "fences").select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "f")
    # A stored table's size is known when the plan is made, so Spark broadcasts it only below its own threshold.
    both = rows.join(f, F.expr("lang <=> f_lang and source <=> f_source"), "left")
    inside = [F.expr(f"({e.replace('n_', 'q.n_').replace('word_chars', 'q.word_chars')}) <= f.{k}") for k, e in _RATIOS.items()]
    inside.append(F.expr("1000 * q.word_chars div greatest(q.n_words, 1) >= f.shortest"))
    verdict = F.lit(True)
    for x in inside:
        verdict = verdict & F.coalesce(x, F.lit(True))
    return both.withColumn("kept", ~F.col("q.base_failed") & verdict).drop("f_lang", "f_source", "f")


def _named(docs: DataFrame) -> DataFrame:
    """Rows (doc, lang, source): the whole row as one struct, so that no column of the input can clash."""
    has = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    return docs.select(F.struct("*").alias("doc"), has["lang"].alias("lang"), has["source"].alias("source"))


def assess(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each document."""
    # only numbers are stored between the two steps
    rows = stored(counts(_named(docs), F.col("doc.text")).select(F.col("doc.doc_id").alias("doc_id"), "lang", "source", "q"), "quality")
    return judged(rows).select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    rows = counts(_named(docs), F.col("doc.text"))
    # Parts of q are never worked out again for each use of it: nothing is pushed through explode.
    rows = rows.select("doc", "lang", "source", F.explode(F.array("q")).alias("q"))
    # Only numbers are stored between the two steps, so texts are counted twice; stored texts would take the disk of another input while all later stages run.
    return judged(rows, stored(rows.select("lang", "source", "q"), "quality")).where("kept").select("doc.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * word_chars // greatest(n_words, 1) AS word_length FROM s),
m AS (SELECT lang, source, metric, CASE WHEN x < 32 THEN x ELSE (x >> (length(bin(x)) - 6)) << (length(bin(x)) - 6) END AS v FROM (
  SELECT lang, source, 'symbols' AS metric, symbols AS x FROM b WHERE NOT base_failed UNION ALL SELECT lang, source, 'dup_lines', dup_lines FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeats', repeats FROM b WHERE NOT base_failed UNION ALL SELECT lang, source, 'word_length', word_length FROM b WHERE NOT base_failed)),
q AS (SELECT metric, lang, source, list_sort(list(v)) AS vs FROM m GROUP BY ALL),
ql AS (SELECT metric, lang, list_sort(list(v)) AS vs FROM m GROUP BY ALL),
qe AS (SELECT metric, list_sort(list(v)) AS vs FROM m GROUP BY ALL),
s1 AS (SELECT 1 AS tier, metric, lang, source, vs FROM q UNION ALL SELECT 2, metric, lang, NULL, vs FROM ql UNION ALL SELECT 3, metric, NULL, NULL, vs FROM qe),
s2 AS (SELECT tier, metric, lang, source, CAST(len(vs) AS BIGINT) AS n, vs[(len(vs) + 1) // 2] AS q50, vs[(9 * len(vs) + 9) // 10] AS h, vs[(len(vs) + 9) // 10] AS low,
  CASE metric WHEN 'symbols' THEN 8 WHEN 'word_length' THEN 8 ELSE 24 END AS k, vs FROM s1),
s3 AS (SELECT *, CASE WHEN h < 32 THEN h ELSE h + (1 << (length(bin(h)) - 6)) - 1 END AS high, k * CAST(list_sum(list_transform(vs, lambda x: abs(x - q50))) AS BIGINT) // n AS away FROM s2),
s4 AS (SELECT tier, metric, lang, source, n, high, low, greatest(high, q50 + away) AS f, least(low, greatest(0, q50 - away)) AS g FROM s3),
z AS (SELECT o.metric, o.lang, o.source, o.n, o.high, o.low, (o.n * o.f + 50 * ((l.n * l.f + 50 * e.f) // (l.n + 50))) // (o.n + 50) AS f, (o.n * o.g + 50 * ((l.n * l.g + 50 * e.g) // (l.n + 50))) // (o.n + 50) AS g
  FROM s4 o JOIN s4 l ON l.tier = 2 AND l.metric = o.metric AND l.lang IS NOT DISTINCT FROM o.lang JOIN s4 e ON e.tier = 3 AND e.metric = o.metric WHERE o.tier = 1),
y AS (SELECT metric, lang, source, CASE WHEN n >= 50 THEN greatest(f, high) ELSE f END AS f, CASE WHEN n >= 50 THEN least(g, low) ELSE g END AS g FROM z),
f AS (SELECT lang, source, max(CASE WHEN metric = 'symbols' THEN f END) AS f_symbols, max(CASE WHEN metric = 'dup_lines' THEN f END) AS f_dup_lines,
  max(CASE WHEN metric = 'repeats' THEN f END) AS f_repeats, max(CASE WHEN metric = 'word_length' THEN f END) AS f_longest, max(CASE WHEN metric = 'word_length' THEN g END) AS f_shortest FROM y GROUP BY ALL)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= f_symbols, true) AND coalesce(dup_lines <= f_dup_lines, true) AND coalesce(repeats <= f_repeats, true)
  AND coalesce(word_length <= f_longest, true) AND coalesce(word_length >= f_shortest, true) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""
