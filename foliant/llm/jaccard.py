"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct five-word shingles, the tokens. Documents with equal sets are one class from the start. Classes are then put into
groups of similar ones, each group stores the union of its members' tokens (its row of the token-group matrix), a class asks a group only
if the overlap of its set with that union can reach the limit, and only groups that qualify are opened, that is, their
members are compared one by one, exactly, on whole sets.

No link is lost. Sets of n and m tokens link if 7 * overlap >= 3 * (n + m), so each shares three quarters of its tokens with the other. A token that one class alone has is in no
overlap: a class that has too many of them (counted in the part of its tokens with the least hashes, HEAD of them) has no links and drops out. Of the others all tokens are
put in one order, the rarest first. Two sets that link have one of their first n // 4 + 1 tokens in common, their keys; so classes
without a common key need not meet. Of the first token that two sets share, what comes before is in no overlap: if it is the i-th of n (from 0), the overlap is n - i at most. So a class asks by a key only if
7 * (n - i) >= 3 * (n + m) holds, and the same from the other side; the first token in common passes whenever two sets link.

How groups come about: in a few rounds each class is compared with one hub, of the largest group that it shares one of its first HUB_KEYS keys with; links so proven
make the groups grow. Then classes ask all other groups that they share any key with, the smaller group the larger. Groups are asked in parts of
about PART tokens and classes ask in lists of as many, so no row grows with a group; hot keys are split.

Classes are named by 64-bit hashes of their sets, and tokens are 64-bit hashes.

Defined results: null or empty texts have an empty set and are linked with nothing; a text of fewer than five words is one shingle; rows that
repeat a doc_id are judged each and share ids; documents with null ids take part and never name a component that has another
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sieve, components, discard, split_join, stored, sweep
from .tokens import ends, pieces

N = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Of a set's tokens, the part (in eighths) in which those of one class alone are counted first.
HEAD = 3
#: Keys by which a class looks for hubs.
HUB_KEYS = 8
#: Tokens of a part of a group, or of a list of classes, unless one class has more.
PART = 2**15
#: Rounds of hubs; hubs are the members with most shared tokens and, every other round, any members.
ROUNDS = 3

_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M
    return h ^ (h >> np.uint64(32))


def shingle_sets(words: list[list[bytes]]) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    at = ends(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, (w for ws in words for w in ws)), dtype=np.uint64, count=int(at[-1]))
    grams = np.zeros(max(0, len(h) - N + 1), dtype=np.uint64)
    for j in range(N):
        grams = grams * _M + h[j : j + len(grams)]
    grams = _mixed(grams)
    out = []
    for b, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - b >= N:
            out.append(np.unique(grams[b : e - N + 1]))
        elif e > b:
            one = np.uint64(e - b)
            for w in h[b:e]:
                one = np.uint64((int(one) * int(_M) + int(w)) % 2**64)
            out.append(_mixed(np.array([one], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _named(batches) -> Iterator[tuple[pa.Array, list[np.ndarray], list[int | None]]]:
    """(ids, sets, names of the sets; None of an empty one) of bounded pieces of the batches."""
    for b in batches:
        for start, words in pieces(b.column("t")):
            sets = shingle_sets(words)
            yield b.column("id").slice(start, len(words)), sets, [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]


def _names(batches):
    for ids, sets, nodes in _named(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())], names=["id", "n", "node"])


def _heads(batches):
    """(t, node): the tokens with the least hashes of each set, once in a partition."""
    done: set[int] = set()
    for _, sets, nodes in _named(batches):
        new = {}
        for s, node in zip(sets, nodes):
            if node is not None and node not in done:
                new[node] = s[: len(s) * HEAD // 8 + 1]
        done.update(new)
        if new:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(new.values())).view(np.int64)), pa.array(np.repeat(np.array(list(new), dtype=np.int64), [len(s) for s in new.values()]))], names=["t", "node"])


def _tokens(batches, sieve):
    """(node, tokens) of the sets whose names pass the sieve, once in a partition."""
    done: set[int] = set()
    for _, sets, nodes in _named(batches):
        names = np.array([n or 0 for n in nodes], dtype=np.int64)
        may = sieve.value.may(names.view(np.uint64))
        new = {n: s for n, s, m in zip(nodes, sets, may) if m and n is not None and n not in done}
        done.update(new)
        yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), _lists([s.view(np.int64) for s in new.values()])], names=["node", "tokens"])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)))


def _proven(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of stored pairs (a, b, hg) that link, by their whole sets. Many a may have the same b."""
    one = sets.selectExpr("node as a", "tokens as at")
    two = sets.selectExpr("node as b", "tokens as bt")
    both = split_join(pairs.join(one, "a"), two, "b", pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")), "a")
    return both.selectExpr("a", "b", "hg", "size(array_intersect(at, bt)) as i", "size(at) + size(bt) as s").where(f"100L * i >= {PERCENT}L * (s - i)").select("a", "b", "hg")


def _able(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored (node, n, s, tokens, keys) of the classes that can link: how many tokens they share with others, all tokens, and their keys, the rarest first."""
    # Tokens of one class alone, counted at their only owner.
    alone = rows.mapInArrow(_heads, "t long, node long").groupBy("t").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo = hi").groupBy("lo").agg(F.count(F.lit(1)).alias("u"))
    some = stored(nodes.join(alone, F.expr("node = lo"), "left").where("4 * (n - coalesce(u, 0L)) >= 3 * n").select("node"), "some")
    del alone
    sweep(rows.sparkSession)
    sieve = rows.sparkSession.sparkContext.broadcast(Sieve(some, "node"))
    sets = rows.mapInArrow(lambda bs: _tokens(bs, sieve), "node long, tokens array<long>").join(some, "node", "left_semi")
    sets = stored(sets.groupBy("node").agg(F.first("tokens").alias("tokens")), "tokens")
    sweep(rows.sparkSession)
    each = sets.selectExpr("node", "explode(tokens) as t")
    shared = stored(each.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared-tokens")
    sweep(rows.sparkSession)
    # Each shuffle of all tokens is gone before the next one is written.
    owned = stored(split_join(each, shared, "t", shared, "node").select("node", "c", "t"), "owned-tokens")
    discard(shared)
    sweep(rows.sparkSession)
    ranked = owned.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("ks"))
    both = sets.join(ranked, "node").selectExpr("node", "bigint(size(tokens)) as n", "bigint(size(ks)) as s", "tokens", "ks").where("4 * s >= 3 * n")
    # Tokens of one class alone are the rarest: of the first n // 4 + 1 tokens they take n - s places.
    able = stored(both.selectExpr("node", "n", "s", "tokens", "slice(ks.t, 1, int(n div 4 + 1 - n + s)) as keys"), "able")
    discard(sets, owned)
    return able


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (id, t), t the text as bytes: stored rows (id, n, node), and (node, component) for each node; component names its least id."""
    id_field = rows.schema["id"]
    schema = T.StructType([id_field, T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])
    seen = stored(rows.mapInArrow(_names, schema), "sets")
    nodes = stored(seen.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n")), "classes")
    able = _able(rows, nodes)
    sweep(rows.sparkSession)
    sets = able.select("node", "tokens")
    # i: how many tokens of the set come before the key.
    keyed = able.selectExpr("node", "n", "s", "posexplode(keys) as (p, key)").selectExpr("node", "n", "s", "n - s + p as i", "key")
    live = stored(keyed.where(f"i < n - s + {HUB_KEYS}").selectExpr("*", "node as g", "1L as size"), "live-keys")
    # Whoever links with a hub takes the name of its group. So all of one name link, in one or more steps, with the class of that name, whatever names others take.
    links, groups = None, able.selectExpr("node", "node as root", "1L as gs")
    for turn in range(ROUNDS):
        rank = "double(s) / n" if turn % 2 == 0 else f"double(xxhash64(node, {turn}))"
        hubs = live.groupBy("key").agg(F.max(F.expr(f"struct(size, g, {rank} as rank, node, n, s)")).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "c", "h.*")
        hubs = stored(hubs.selectExpr("key", "c", "g as hg", "rank", "node as b", "n as bn", "s as bs"), "hubs")
        asked = split_join(live, hubs.drop("c"), "key", hubs, "node").where("g != hg and 7 * least(s, bs) >= 3 * (n + bn)").groupBy("node").agg(F.max(F.struct("rank", "b", "hg")).alias("h"))
        found = stored(_proven(stored(asked.selectExpr("node as a", "h.b as b", "h.hg as hg"), "hub-pairs"), sets), "hub-links")
        links = found.select("a", "b") if links is None else links.unionAll(found.select("a", "b"))
        named = groups.select("node", "root").join(found.selectExpr("a as node", "hg"), "node", "left").selectExpr("node", "coalesce(hg, root) as root")
        sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("gs"))
        groups = stored(named.join(sizes, "root").select("node", "root", "gs"), "groups")
        if turn < ROUNDS - 1:
            before, live = live, stored(_grouped(live.select("node", "n", "s", "i", "key"), groups), "live-keys")
            discard(before, hubs)
    discard(live)
    del asked, hubs, named, sizes, before
    sweep(rows.sparkSession)
    live = stored(_grouped(keyed, groups), "live-keys")
    able = able.select("node", "n", "s")
    # What is left asks the other groups that it shares a key with, the smaller one the larger.
    there = live.groupBy("key", "g", "size").agg(F.max("s").alias("os"), F.min("n").alias("o_n"), F.max(F.expr("4 * n - 7 * i")).alias("far")).selectExpr("key", "g as other", "size as other_size", "os", "o_n as on_", "far")
    asks = live.join(there, "key").where("struct(size, g) < struct(other_size, other) and 7 * least(s, os) >= 3 * (n + on_) and 7 * i <= 4 * n - 3 * on_ and far >= 3 * n").select("node", "n", "s", "other", "other_size").distinct()
    asks = stored(asks, "asks")
    discard(live)
    del there
    sweep(rows.sparkSession)
    # The matrix: groups asked, in parts of bounded size, with members, the union of their tokens, and what any of them can reach.
    wanted = asks.select("other").distinct()
    inside = groups.selectExpr("node", "root as other").join(wanted, "other", "left_semi")
    inside = inside.join(able, "node")
    big = inside.groupBy("other").agg(F.sum("n").alias("c"))
    members = inside.join(big, "other").join(sets, "node").selectExpr("other", f"pmod(xxhash64(node), greatest(1L, c div {PART})) as part", "node", "n", "s", "tokens")
    matrix = members.groupBy("other", "part").agg(F.collect_list(F.struct("node", "n", "s", "tokens")).alias("members"), F.max("s").alias("ps"), F.min("n").alias("pn"))
    matrix = stored(matrix.withColumn("all", F.expr("array_distinct(flatten(transform(members, m -> m.tokens)))")), "matrix")
    at = asks.join(matrix.select("other", "part", "ps", "pn"), "other").where("7 * least(s, ps) >= 3 * (n + pn)").select("other", "part", "node", "n", "s")
    many = at.groupBy("other", "part").agg(F.sum("n").alias("c"))
    lists = at.join(many, ["other", "part"]).join(sets, "node").selectExpr("other", "part", f"pmod(xxhash64(node, 1), greatest(1L, c div {PART})) as list", "node", "n", "s", "tokens")
    lists = lists.groupBy("other", "part", "list").agg(F.collect_list(F.struct("node", "n", "s", "tokens")).alias("qs"))
    opened = lists.join(matrix, ["other", "part"]).select(F.expr("""flatten(transform(filter(qs, q -> 4 * size(array_intersect(q.tokens, `all`)) >= 3 * q.n),
      q -> transform(filter(members, m -> 7 * least(q.s, m.s) >= 3 * (q.n + m.n) and 7L * size(array_intersect(q.tokens, m.tokens)) >= 3 * (q.n + m.n)), m -> struct(q.node as a, m.node as b))))""").alias("found"))
    second = stored(opened.select(F.explode("found").alias("x")).select("x.a", "x.b"), "group-links")
    linked = components(links.unionAll(second), "links")
    least = linked.join(nodes.select("node", "least"), "node")
    named = least.groupBy("root").agg(F.min("least").alias("component"))
    of = least.join(named, "root").select("node", F.col("component").alias("c"))
    return seen.select("id", "n", "node"), nodes.select("node", "least").join(of, "node", "left").selectExpr("node", "coalesce(c, least) as component")


def _grouped(live: DataFrame, of: DataFrame) -> DataFrame:
    """Rows (node, n, s, i, key) with their group g and its size; keys that lie within one group are done."""
    all_ = live.join(of, "node").selectExpr("key", "node", "n", "s", "i", "root as g", "gs as size")
    mixed = stored(all_.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo != hi").select("key", "c"), "mixed-keys")
    return split_join(all_, mixed.select("key"), "key", mixed, "node")


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document."""
    seen, of = classes(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("t")))
    alone = seen.where("node is null").selectExpr("id as doc_id", "n as n_shingles", "id as component_id")
    return seen.where("node is not null").join(of, "node").selectExpr("id as doc_id", "n as n_shingles", "component as component_id").unionAll(alone)


def one_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least id, and all documents without words; with their own columns."""
    packed = docs.select(F.struct("*").alias("doc")).withColumn("id", F.expr("struct(doc.doc_id as doc_id, xxhash64(doc) as h)"))
    worded = F.coalesce(F.col("doc.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    full = packed.where(worded)
    _, of = classes(full.select("id", F.col("doc.text").cast("binary").alias("t")))
    kept = stored(of.select(F.col("component.h").alias("k_h"), F.col("component.doc_id").alias("k_id")).distinct(), "kept")
    rows = full.selectExpr("id.h as h", "id.doc_id as d", "doc").join(kept, F.expr("h = k_h and d <=> k_id"), "left_semi").dropDuplicates(["h", "d"])
    return rows.select("doc.*").unionAll(packed.where(~worded).select("doc.*"))
