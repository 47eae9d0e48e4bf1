"""Sharding by extendible hashing: a directory over hash-prefix bits in which only buckets over the limit split.

A first pass adds up bytes by prefix at a depth a little beyond what an even split would need (the cells), and every shorter prefix
from the cells. A bucket is the shortest prefix whose bytes fit; so neighbours of a large bucket stay whole. Cells that
do not fit themselves are refined by further bits, they alone, until they fit or hold one key only.

Defined results: a null text has 0 bytes; a document over the limit has a shard of its own; rows that are alike in id and bytes share all
hash bits, so they fill overflow shards (-0, -1, ...) one after the other; null ids are a key like any other; an empty table gives no shard.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LIMIT = 32 * 2**20
#: Bits by which cells are finer than an even split, and that a refinement adds.
FINER = 4
#: Bits of a hash.
BITS = 60


def _prefix(depth: str) -> str:
    return f"substring(bits, 1, {depth})"


def shards(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """From rows (id, bytes): a row for each (id, bytes, shard, depth); shard is the prefix in 0 and 1, `-n` added for overflow."""
    keys = rows.groupBy("id", "bytes").agg(F.count(F.lit(1)).alias("c"))
    keys = keys.selectExpr("id", "bytes", "c", "bytes * c as total", f"right(lpad(bin(xxhash64(id, bytes)), 64, '0'), {BITS}) as bits")
    keys = stored(keys, "shard-keys")
    total = keys.agg(F.sum("total")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + FINER)
    live, buckets, low = keys, None, 0
    while True:
        cells = stored(live.groupBy(F.expr(_prefix(str(depth))).alias("cell")).agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("n")), "shard-cells")
        sums = cells.selectExpr("total", "n", f"explode(transform(sequence({low}, {depth}), d -> substring(cell, 1, d))) as prefix").groupBy("prefix").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        fits = f"total <= {limit} or n = 1" + (" or true" if depth == BITS else "")
        # The shortest prefix that fits: one that fits while its parent does not.
        held = sums.withColumn("fits", F.expr(fits))
        parents = held.selectExpr("prefix as parent", "fits as parent_fits")
        found = held.where("fits").join(parents, F.expr(f"parent = substring(prefix, 1, length(prefix) - 1) and length(prefix) > {low}"), "left").where("not coalesce(parent_fits, false)").select("prefix")
        found = stored(found, "shard-buckets")
        buckets = found if buckets is None else buckets.unionAll(found)
        if depth == BITS or not cells.where(f"not ({fits})").limit(1).count():
            break
        over = cells.where(f"not ({fits})").selectExpr("cell as over_cell")
        live = stored(live.join(over, F.expr(f"{_prefix(str(depth))} = over_cell"), "left_semi"), "shard-live")
        low, depth = depth + 1, min(BITS, depth + FINER)
    # A key meets its bucket by an equal prefix: the depths that occur are few (at most BITS), the rows of each one small.
    depths = sorted(x[0] for x in buckets.select(F.length("prefix")).distinct().collect())
    tried = keys.selectExpr("*", f"explode(array({', '.join(map(str, depths)) or '0'})) as depth").withColumn("prefix", F.expr("substring(bits, 1, depth)"))
    placed = tried.join(buckets, "prefix")
    each = placed.selectExpr("id", "bytes", "prefix", "depth", "total", "explode(sequence(1L, c)) as k")
    per = f"greatest(1L, {limit} div greatest(bytes, 1L))"
    return each.selectExpr("id", "bytes", f"if(total > {limit} and total > bytes, concat(prefix, '-', (k - 1) div {per}), prefix) as shard", "depth")


def directory(placed: DataFrame) -> DataFrame:
    """(shard, depth, n_docs, n_bytes) of every shard."""
    return placed.groupBy("shard", "depth").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("bytes").alias("n_bytes"))


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_docs) for each document; the bytes are those of its text in UTF-8."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    placed = stored(shards(rows, limit), "shard-rows")
    of = directory(placed).selectExpr("shard as of", "n_docs as shard_docs", "n_bytes as shard_bytes")
    of = stored(of, "shard-directory")
    return placed.join(of, F.expr("shard = of")).selectExpr("id as doc_id", "bytes as n_bytes", "shard", "depth", "shard_bytes", "shard_docs")
