"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source gets the same expected copies, its source's target over its size: the whole part for certain, the
rest as a probability. Pairs of documents then pass words to each other, in a random direction that leaves expectations
as they are, until one of the pair takes all or nothing; the other goes on. So a source's words stay at its target throughout and
the last residual alone can move them, by less than one document.

The pairs form a reduction tree: a block of about BLOCK documents is folded inside one row, its one residual goes to the
block above. A source of n documents needs log_BLOCK(n) levels and no task holds more than a few blocks. Random numbers are
hashes of the document, so reruns agree.

Defined results: a null or empty text has size 0 and takes 0; null sources are one source, the last; rows that repeat are
rounded each on its own; an empty table gives an empty result; a document without words never counts as copied by chance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored

BLOCK = 64


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size).

    Sources by code point, nulls last, weigh `weights` in turn. Sources whose share exceeds `most` times their size stop there; the
    order of cap over weight decides which, so one pass over the running sums finds the level that the others share.
    """
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    picks = ", ".join(map(str, weights))
    a = by.selectExpr("*", f"double(element_at(array({picks}), int((row_number() over (order by source asc nulls last) - 1) % {len(weights)} + 1))) as w")
    a = a.selectExpr("*", f"{most}D * source_size as cap", f"{most}D * source_size / w as r", f"{share}D * sum(source_size) over () as total", "sum(w) over () as all_w")
    a = a.selectExpr("*", "sum(cap) over (order by r, source asc nulls last rows between unbounded preceding and 1 preceding) as cap_before",
                     "sum(w) over (order by r, source asc nulls last rows between unbounded preceding and 1 preceding) as w_before")
    # The level if all sources before this one are capped; the first that lies under its own cap sets it for all.
    a = a.selectExpr("*", "greatest(0D, total - coalesce(cap_before, 0D)) / (all_w - coalesce(w_before, 0D)) as level")
    a = a.selectExpr("*", "min(if(r > level, struct(r, level), null)) over () as first_free")
    return a.selectExpr("source", "n", "source_size", "if(first_free is null or r < first_free.r, cap, least(cap, first_free.level * w)) as target")


def _fold(level: int) -> str:
    """SQL: folds the sorted array `xs` of (id, m, s), m of s words expected, to out (id, bit) and at most one residual."""
    x_u = f"(pmod(xxhash64(x.id, {level}), 1000003) + 0.5D) / 1000003"
    give, take = "least(a.s - a.m, x.m)", "least(x.s - x.m, a.m)"
    state = lambda who, m, out: f"named_struct('id', {who}.id, 'm', {m}, 's', {who}.s, 'out', {out})"
    add = lambda who, bit: f"concat(a.out, array(named_struct('id', {who}.id, 'bit', {bit})))"
    return f"""aggregate(slice(xs, 2, greatest(size(xs) - 1, 0)),
      named_struct('id', xs[0].id, 'm', xs[0].m, 's', xs[0].s, 'out', slice(transform(xs, x -> named_struct('id', x.id, 'bit', 0)), 1, 0)),
      (a, x) -> if({x_u} * ({give} + {take}) < {take},
        if(a.s - a.m <= x.m, {state('x', f'x.m - {give}', add('a', 1))}, {state('a', 'a.m + x.m', add('x', 0))}),
        if(x.s - x.m <= a.m, {state('a', f'a.m - {take}', add('x', 1))}, {state('x', 'x.m + a.m', add('a', 0))})))"""


def mix(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From rows (id, source, size): a row for each (id, source, size, source_size, target, copies). id may be any type, and may repeat."""
    # Rows alike in all three are told apart by a running number, without a window over a key.
    rows = stored(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("c")), "mix-rows").selectExpr("id", "source", "size", "explode(sequence(1L, c)) as k")
    targets = stored(source_targets(rows, weights, share, most), "mix-targets").selectExpr("source as t_source", "n", "source_size", "target", "if(source_size > 0, target / source_size, 0D) as x")
    levels, left = 1, targets.agg(F.max("n")).first()[0] or 0
    while left > BLOCK:
        left, levels = -(-left // BLOCK), levels + 1
    at = rows.join(targets, F.expr("source <=> t_source"))
    block = f"if(size > 0, pmod(xxhash64(id, size, k, -1), greatest(1L, (n + {BLOCK - 1}) div {BLOCK})), -1L)"
    live = at.selectExpr("source", f"{block} as b", "struct(id, size, k) as id", "(x - floor(x)) * size as m", "double(size) as s")
    bits = live.where("b < 0").selectExpr("source", "id", "0 as bit")
    live = live.where("b >= 0")
    for level in range(levels):
        folded = live.groupBy("source", "b").agg(F.array_sort(F.collect_list(F.expr("struct(xxhash64(id) as h, id, m, s)"))).alias("xs")).select("source", "b", F.expr(_fold(level)).alias("a"))
        folded = stored(folded, f"mix-level{level}")
        bits = bits.unionAll(folded.selectExpr("source", "inline(a.out)"))
        live = folded.selectExpr("source", f"b div {BLOCK} as b", "a.id as id", "a.m as m", "a.s as s")
    bits = bits.unionAll(live.selectExpr("source", "id", "if((pmod(xxhash64(id, -2), 1000003) + 0.5D) / 1000003 * s < m, 1, 0) as bit"))
    done = bits.join(targets, F.expr("source <=> t_source"))
    return done.selectExpr("id.id as id", "source", "id.size as size", "source_size", "target", "bigint(floor(x)) + bit as copies")


def size_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source"), size_of(F.col("text")).alias("size"))
    return mix(rows).selectExpr("id as doc_id", "size", "source_size", "target", "copies * size as taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    packed = docs.select(F.struct("*").alias("doc")).withColumn("key", F.expr("struct(doc.doc_id as doc_id, xxhash64(doc) as h)"))
    plan = mix(packed.select(F.col("key").alias("id"), F.col("doc.source").alias("source"), size_of(F.col("doc.text")).alias("size")))
    # Rows that agree in all columns are one row here, taken as often as all of them together.
    plan = plan.groupBy("id").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0").selectExpr("id.h as p_h", "id.doc_id as p_id", "copies")
    rows = packed.selectExpr("key.h as h", "key.doc_id as id", "doc").dropDuplicates(["h", "id"])
    return rows.join(plan, F.expr("h = p_h and id <=> p_id")).selectExpr("doc", "explode(sequence(1, copies)) as copy").select("doc.*")
