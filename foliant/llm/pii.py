"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust their score.

Positions are code points, the end exclusive. Everything is a Spark expression on the row: no shuffle, no Python. Patterns start
only where a run of their characters starts and never give back what they took; positions are running sums by blocks and the context of a span is read
from the two short pieces of the text around it, so a text of any length and with any number of spans is read in about linear time.

Kinds: email, ip, card (Luhn) and phone are the base, whatever their score; iban (mod 97) and ssn are added when their score
reaches THRESHOLD. Defined results: a null or empty text has no spans; rows that repeat are each judged; an empty table
gives an empty result; null ids pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

#: In this order spans that begin together are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
THRESHOLD = 0.6
#: Characters on either side in which context words count.
NEAR = 40
#: Code points of the pieces that a text with spans is cut into, so that the context of a span is read from two of them, not from the text's beginning.
PIECE = 256
_EMAIL_CHAR = r"[A-Za-z0-9._%+-]"

#: kind -> (cheap guard, pattern, what a match must pass, score without context, score that context adds, context words)
RULES = {
    "email": ("instr({t}, '@') > 0", rf"(?:(?<!{_EMAIL_CHAR})|\G){_EMAIL_CHAR}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, 0.1, "mail|contact|write"),
    "ip": (r"{t} rlike '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++(?:[.][0-9]++){{3}}", "forall(split(x, '[.]'), p -> p rlike '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')", 0.6, 0.2, "ip|address|server|host"),
    "card": ("{t} rlike '[0-9](?:[ -]?[0-9]){{11}}'", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){{11,18}}+(?![ -]?[0-9])", "{luhn}", 0.8, 0.2, "card|visa|credit|payment"),
    "phone": (r"{t} rlike '[+][0-9]'", r"[+][0-9][ ().0-9-]+[0-9]", "length(regexp_replace(x, '[^0-9]', '')) between 9 and 15", 0.7, 0.2, "phone|call|tel|mobile|fax"),
    "iban": ("{t} rlike '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11}}'", r"(?<![A-Za-z0-9_])[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}+(?![A-Za-z0-9_])", "{mod97}", 0.8, 0.2, "iban|bank|account|transfer"),
    "ssn": ("{t} rlike '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'", r"(?<![A-Za-z0-9_])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![A-Za-z0-9_])", "not x rlike '^(?:000|666|9)|-00-|-0000$'", 0.3, 0.5, "ssn|social security|taxpayer"),
}
_DIGITS = "regexp_replace(x, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + aggregate(array(int(substring({_DIGITS}, -i, 1))), 0,
  (b, d) -> b + if(i % 2 = 0, 2 * d - if(d > 4, 9, 0), d))) % 10 = 0"""
#: The first four characters go last and letters count 10 to 35; the remainder is carried along.
_MOD97 = """aggregate(split(concat(substring(x, 5), substring(x, 1, 4)), ''), 0, (a, ch) -> case when ch rlike '[0-9]' then (a * 10 + int(ch)) % 97
  when ch rlike '[A-Z]' then (a * 100 + ascii(ch) - 55) % 97 else a end) = 1"""


def _spans(kind: str, valid: str) -> str:
    """SQL: (s, e, rank, kind) of the matches in p_x that pass `valid`; pieces between matches and the matches alternate, so running sums of their lengths are positions."""
    sizes = "transform(pii_m.x, (x, i) -> bigint(length(get(pii_m.b, i)) + length(x)))"
    one = f"named_struct('s', get(pii_at, i) + length(get(pii_m.b, i)), 'e', get(pii_at, i) + length(get(pii_m.b, i)) + length(x), 'rank', {KINDS.index(kind)}, 'kind', '{kind}')"
    found = f"filter(transform(pii_m.x, (x, i) -> if({valid}, {one}, null)), z -> z is not null)"
    return let("named_struct('x', p_x, 'b', p_between)", "pii_m", let(running_sums(sizes), "pii_at", found))


def _scored() -> str:
    """SQL: p_all with the score of each span; the text is cut once and a context is read from the two pieces around it."""
    piece = "concat(coalesce(get(pii_t, int({at} div {n})), ''), coalesce(get(pii_t, int({at} div {n}) + 1), ''))"
    before = f"substring({piece.format(at=f'greatest(0L, z.s - {NEAR})', n=PIECE)}, int(greatest(0L, z.s - {NEAR}) % {PIECE}) + 1, int(least({NEAR}L, z.s)))"
    after = f"substring({piece.format(at='z.e', n=PIECE)}, int(z.e % {PIECE}) + 1, {NEAR})"
    cases = " ".join(f"when {KINDS.index(k)} then {RULES[k][3]}D + if(pii_w rlike '{RULES[k][5]}', {RULES[k][4]}D, 0D)" for k in KINDS)
    one = let(f"lower(concat({before}, ' ', {after}))", "pii_w", f"named_struct('s', z.s, 'e', z.e, 'rank', z.rank, 'kind', z.kind, 'score', case z.rank {cases} end)")
    return let(f"regexp_extract_all(p_text, '(?s).{{1,{PIECE}}}', 0)", "pii_t", f"transform(p_all, z -> {one})")


def find(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the column `pii`: array of (s, e, rank, kind, score) by start, then kind."""
    a = rows.withColumn("p_text", F.coalesce(text, F.lit("")))
    a = a.withColumn("p_digit", F.col("p_text").rlike("[0-9]"))
    none = "cast(array() as array<struct<s:bigint,e:bigint,rank:int,kind:string>>)"
    for kind in KINDS:
        guard, pattern, valid = (x for x in RULES[kind][:3])
        guard, pattern = guard.format(t="p_text"), pattern.format()
        valid = _LUHN if kind == "card" else _MOD97 if kind == "iban" else valid.format() if kind != "ssn" else valid
        if kind != "email":
            guard = f"p_digit and {guard}"
        a = a.withColumn("p_x", F.when(F.expr(guard), F.regexp_extract_all("p_text", F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")))
        a = a.withColumn("p_between", F.when(F.size("p_x") > 0, F.split("p_text", pattern, -1)))
        a = a.withColumn(f"p_{kind}", F.expr(f"if(size(p_x) = 0, {none}, {_spans(kind, valid)})"))
    a = a.withColumn("p_all", F.concat(*(F.col(f"p_{k}") for k in KINDS)))
    a = a.withColumn("p_scored", F.expr(f"if(size(p_all) = 0, cast(array() as array<struct<s:bigint,e:bigint,rank:int,kind:string,score:double>>), {_scored()})"))
    kept = f"filter(p_scored, z -> z.rank < {BASE} or z.score >= {THRESHOLD}D)"
    return a.withColumn("pii", F.expr(f"array_sort({kept})")).drop("p_text", "p_digit", "p_x", "p_between", "p_all", "p_scored", *[f"p_{k}" for k in KINDS])


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) for each document."""
    a = find(docs.select("doc_id", F.col("text").alias("whole")), F.col("whole"))
    n = [f"bigint(size(filter(pii, z -> z.kind = '{k}'))) as n_{k}" for k in KINDS[:BASE]]
    written = "array_join(transform({}, z -> concat(z.kind, ':', z.s, ':', z.e)), ',')"
    base = written.format(f"filter(pii, z -> z.rank < {BASE})")
    return a.selectExpr("doc_id", *n, f"sha2({base}, 256) as base_sha256", f"{written.format('pii')} as spans",
                        "array_join(transform(pii, z -> string(bigint(round(100 * z.score)))), ',') as scores")


def masked(docs: DataFrame) -> DataFrame:
    """The documents with each span of `text` replaced by its kind in angle brackets; where spans overlap, the first one counts."""
    a = find(docs.select(F.struct("*").alias("doc")), F.col("doc.text"))
    apart = """aggregate(pii, cast(array() as array<struct<s:bigint,e:bigint,kind:string>>), (a, z) ->
      if(size(a) > 0 and element_at(a, -1).e > z.s, a, concat(a, array(named_struct('s', z.s, 'e', z.e, 'kind', z.kind)))))"""
    a = a.withColumn("apart", F.expr(apart))
    parts = """concat(array_join(transform(apart, (z, i) -> concat(substring(doc.text, int(coalesce(get(apart, i - 1).e, 0L) + 1), int(z.s - coalesce(get(apart, i - 1).e, 0L))), '<', z.kind, '>')), ''),
      substring(doc.text, int(coalesce(element_at(apart, -1).e, 0L) + 1)))"""
    text = F.expr(f"if(doc.text is null or size(apart) = 0, doc.text, {parts.replace('element_at(apart, -1)', 'get(apart, size(apart) - 1)')})")
    return a.withColumn("doc", F.col("doc").withField("text", text)).select("doc.*")


def _sql(kind: str, pattern: str, valid: str) -> str:
    """SQL of the spans of one kind: string_split_regex gives what lies between, its lengths and the matches' the positions."""
    return f"""{kind}_m AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS xs, string_split_regex(t, '{pattern}') AS bs FROM d),
{kind}_s AS (SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS rank, s, s + length(x) AS e, t FROM (
  SELECT doc_id, t, xs[i] AS x, list_sum(list_transform(bs[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(xs[1:i-1], lambda y: length(y))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM {kind}_m)) WHERE {valid})"""


_SQL_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
ORACLE_SQL = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\n" + ",\n".join((
    _sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    _sql("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0"),
    _sql("card", r"[0-9]([\x20-]?[0-9])+", f"length({_SQL_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_SQL_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN 2 * CAST({_SQL_DIGITS}[-i] AS INT) - CASE WHEN CAST({_SQL_DIGITS}[-i] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST({_SQL_DIGITS}[-i] AS INT) END)) % 10 = 0"),
    _sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_SQL_DIGITS}) BETWEEN 9 AND 15"),
    _sql("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(x[5:] || x[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS BIGINT) ELSE CAST(ascii(c) - 55 AS BIGINT) END)), lambda a, v: (CASE WHEN v > 9 THEN a * 100 + v ELSE a * 10 + v END) % 97) AS INT) = 1"),
    _sql("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(x, '^(000|666|9)|-00-|-0000$')"),
)) + """,
every AS (""" + " UNION ALL ".join(f"SELECT * FROM {k}_s" for k in KINDS) + f"""),
near AS (SELECT *, lower(t[greatest(1, s - {NEAR - 1}):s] || ' ' || t[e+1:e+{NEAR}]) AS w FROM every),
scored AS (SELECT *, CASE kind """ + " ".join(f"WHEN '{k}' THEN {r[3]} + CASE WHEN regexp_matches(w, '{r[5]}') THEN {r[4]} ELSE 0 END" for k, r in RULES.items()) + f""" END AS score FROM near),
good AS (SELECT * FROM scored WHERE rank < {BASE} OR score >= {THRESHOLD}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {BASE}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
  string_agg(CAST(CAST(round(100 * score) AS BIGINT) AS VARCHAR), ',' ORDER BY s, rank) AS scores FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN a USING (doc_id)
"""
