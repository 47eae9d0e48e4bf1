"""Benchmark decontamination: rare n-grams of the test items are seeds that are joined with the training texts'; around them, Smith-Waterman
alignment of words scores exact, edited and paraphrased copies.

An n-gram is rare if at most RARE_ITEMS of all items have it; items that say the same words are one item with several ids. An item without any rare
n-gram has its rarest ones as seeds, so every item can be found. Seeds of one item that lie close together in a text span a window;
the item is aligned with the window (match +2, mismatch and gap -1) and the score is the best local alignment over that of a
perfect copy. Each window is aligned, none is dropped for its rank.

The corpus is read once, whatever the number of items. Up to three sieves of at most 2**SIEVE_BITS bits, which each worker gets, let the n-grams through that may be seeds, apart for items that need one hit, two or three; they
never hold one back that is, so their size changes only how many are joined for nothing. Texts whose n-grams lie dense enough for some item are kept with their words'
hashes, equal texts once; their n-grams are joined with the table of seeds (salted, so that a passage of many texts is many keys), and windows with their items.

Case and punctuation do not count. Defined results: null or empty texts and items match nothing; items shorter than N words have one seed, all their words; repeated rows are judged
each; columns other than doc_id, text and item_id have no say; empty tables give empty results (or, when filtering, the documents as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sieve, stored
from .tokens import ends, pieces

N = 3
RARE_ITEMS = 8
#: Seeds that a window needs, or a quarter of the item's if that is less.
LEAST_SEEDS = 3
#: Part of a perfect copy's score from which an item counts as leaked.
THRESHOLD = 0.45
#: Bits of a sieve: SIEVE for each seed, 2**SIEVE_BITS at most (32 MiB).
SIEVE, SIEVE_BITS = 512, 28
#: Parts that the seeds of one n-gram are dealt to when they are joined.
SALT = 8
#: Copies may differ in punctuation: ASCII characters that are no letters or digits separate words here.
TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xD6E8FEB86659FD93)


def hashed(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's words begin, and the hashes of all words."""
    at = ends(words)
    return at, np.fromiter(map(xxhash.xxh3_64_intdigest, (w for ws in words for w in ws)), dtype=np.uint64, count=int(at[-1]))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    g = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        g = (g + h[j : len(h) - n + 1 + j]) * _M
    g = (g ^ (g >> np.uint64(32))) * _M2
    return g ^ (g >> np.uint64(29))


class Hits:
    """Which n-grams of a text may be seeds, for each number of hits that items need: (its sieve, the n that occur, that number, within what reach)."""

    def __init__(self, kinds: list[tuple[Sieve, list[int], int, int]]):
        self.kinds = kinds

    def of(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position in it, hash) of the n-grams that pass and have enough others around them, in this order."""
        runs = {n: grams(h, n) for n in {n for kind in self.kinds for n in kind[1]}}
        held = []
        for sieve, lengths, least, reach in self.kinds:
            found = []
            for n in lengths:
                pos = np.flatnonzero(sieve.may(runs[n]))
                row = np.searchsorted(at, pos, side="right") - 1
                whole = pos + n <= at[row + 1]
                found.append((row[whole], pos[whole], runs[n][pos[whole]]))
            row, pos, g = (np.concatenate(x) for x in zip(*found))
            place = pos + row * (2 * reach + 2)  # texts lie further apart than a reach
            one = np.unique(place)
            dense = np.searchsorted(one, place + reach, side="right") - np.searchsorted(one, place - reach, side="left") >= least
            held.append((row[dense], pos[dense], g[dense]))
        row, pos, g = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((g, pos, row))
        row, pos, g = row[order], pos[order], g[order]
        new = np.ones(len(row), dtype=bool)  # what passes for two numbers counts once
        new[1:] = (np.diff(pos) != 0) | (g[1:] != g[:-1])
        row, pos, g = row[new], pos[new], g[new]
        return row, pos - at[row], g


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and the position after its end in text. Words are numbers; equal numbers match."""
    at = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, dtype=np.int64), 0, 0
    for w in item:
        step = np.maximum(row - 1, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(text == w, 2, -1))
        row = np.maximum.accumulate(step + at) - at  # gaps in the item: each word of text that is skipped costs 1
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def windows(found: list[tuple[int, int]], m: int, need: int, size: int) -> Iterator[tuple[int, int]]:
    """[begin, end) of the places in a text of `size` words where an item of m words may lie; found are (position in the text, in the item) of its seeds."""
    by = sorted((pos - p, pos) for pos, p in found)
    begin = 0
    for i in range(1, len(by) + 1):
        if i == len(by) or by[i][0] - by[i - 1][0] > m // 2 + 2:  # another diagonal
            run = by[begin:i]
            begin = i
            if len({pos for _, pos in run}) >= need:
                yield max(0, run[0][0] - m // 2), min(size, run[-1][0] + m + m // 2 + 1)


def _lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, dtype=kind)))


def _items(batches):
    """(item_id, k, ws, grams): an item's key, the hashes of its words, and its n-grams; items without words are left out."""
    for b in batches:
        for start, words in pieces(b.column("t"), table=TABLE):
            at, h = hashed(words)
            own = [h[x:y] for x, y in zip(at[:-1], at[1:])]
            some = [i for i, w in enumerate(own) if len(w)]
            keys = pa.array([xxhash.xxh64_intdigest(b" ".join(words[i])) - 2**63 for i in some], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id").slice(start, len(words)).take(pa.array(some, pa.int64())), keys, _lists([own[i].view(np.int64) for i in some]), _lists([grams(own[i], min(N, len(own[i]))).view(np.int64) for i in some])],
                names=["item_id", "k", "ws", "grams"],
            )


def _seen(batches, hits):
    """(doc_id, t1, t2, ws, pos, g) of the texts with hits: the hashes of all their words, and where which n-gram passes the sieve."""
    find = hits.value.of
    for b in batches:
        for start, words in pieces(b.column("t"), table=TABLE):
            at, h = hashed(words)
            row, pos, g = find(at, h)
            rows, begin = np.unique(row, return_index=True)
            cut = [slice(x, y) for x, y in zip(begin, [*begin[1:], len(row)])]
            take = pa.array(rows + start, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in ("doc_id", "t1", "t2")), _lists([h[at[r] : at[r + 1]].view(np.int64) for r in rows]), _lists([pos[c] for c in cut], np.int32), _lists([g[c].view(np.int64) for c in cut])],
                names=["doc_id", "t1", "t2", "ws", "pos", "g"],
            )


def _placed(batches):
    """(t1, t2, k, lo, hi): the windows of texts and items, from the places of their common seeds."""
    for b in batches:
        rows = []
        for i, (found, m, need, size) in enumerate(zip(*(b.column(c).to_pylist() for c in ("found", "m", "need", "size")))):
            rows += [(i, lo, hi) for lo, hi in windows([(x["pos"], x["p"]) for x in found], m, need, size)]
        take = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("t1", "t2", "k")), *(pa.array([r[j] for r in rows], pa.int32()) for j in (1, 2))], names=["t1", "t2", "k", "lo", "hi"])


def _aligned(batches):
    """(t1, t2, k, score, begin, end) of the windows that hold a copy."""
    for b in batches:
        rows = []
        for i, (item, part, lo) in enumerate(zip(b.column("item"), b.column("part"), b.column("lo").to_pylist())):
            item = item.values.to_numpy()
            score, end = align(item, part.values.to_numpy())
            if score / (2 * len(item)) >= THRESHOLD:
                rows.append((i, score / (2 * len(item)), lo, lo + end))
        take = pa.array([r[0] for r in rows], pa.int64())
        cols = [pa.array([r[j] for r in rows], t) for j, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("t1", "t2", "k")), *cols], names=["t1", "t2", "k", "score", "begin", "end"])


def seeded(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: ids (k, item_id) of the items; (k, ws, m, need) of each different one; and their seeds (g, k, p). Rarity is over all items."""
    read = benchmark.select("item_id", F.lower("text").cast("binary").alias("t"))
    schema = T.StructType([read.schema["item_id"], T.StructField("k", T.LongType()), T.StructField("ws", T.ArrayType(T.LongType())), T.StructField("grams", T.ArrayType(T.LongType()))])
    ids = stored(read.mapInArrow(_items, schema), "items")
    one = stored(ids.groupBy("k").agg(F.first("ws").alias("ws"), F.first("grams").alias("grams")), "different-items")
    common = one.selectExpr("explode(array_distinct(grams)) as g").groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    placed = one.selectExpr("k", "posexplode(grams) as (p, g)").join(common, "g").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("c", "p", "g"))).alias("all"))
    chosen = f"if(all[0].c <= {RARE_ITEMS}, filter(all, x -> x.c <= {RARE_ITEMS}), slice(all, 1, {4 * LEAST_SEEDS}))"
    seeds = stored(placed.selectExpr("k", f"{chosen} as s"), "item-seeds")
    items = one.join(seeds, "k").selectExpr("k", "ws", "size(ws) as m", f"greatest(1, least({LEAST_SEEDS}, size(s) div 4)) as need")
    return ids.select("k", "item_id"), stored(items, "aligned-items"), seeds.selectExpr("k", "inline(s)").select("g", "k", "p")


def hits_of(items: DataFrame, seeds: DataFrame) -> Hits | None:
    """What workers need to find hits; None where there are no items. Items need one hit, two or three."""
    kinds = items.groupBy("need").agg(F.max("m").alias("m"), F.collect_set(F.least("m", F.lit(N))).alias("lengths")).collect()
    sieve = lambda need: Sieve(seeds.join(items.where(F.col("need") == need).select("k"), "k", "left_semi"), "g", SIEVE, SIEVE_BITS)
    return Hits([(sieve(x.need), sorted(x.lengths), x.need, (x.need - 1) * (x.m // 2 + 2) + x.m) for x in kinds]) if kinds else None


def _keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.hash(text)


def _found(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Stored tables (doc_id, t1, t2) of texts with hits, (t1, t2, k, score, begin, end) of what they leak, and ids (k, item_id); None without items."""
    ids, items, seeds = seeded(benchmark)
    hits = hits_of(items, seeds)
    if hits is None:
        return None
    held = docs.sparkSession.sparkContext.broadcast(hits)
    t1, t2 = _keys(F.col("text"))
    rows = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.lower("text").cast("binary").alias("t"))
    array = lambda n, t: T.StructField(n, T.ArrayType(t))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("t1", T.LongType()), T.StructField("t2", T.IntegerType()), array("ws", T.LongType()), array("pos", T.IntegerType()), array("g", T.LongType())])
    seen = stored(rows.mapInArrow(lambda bs: _seen(bs, held), schema), "dense-texts")
    texts = stored(seen.groupBy("t1", "t2").agg(F.first(F.struct("ws", "pos", "g")).alias("x")).select("t1", "t2", "x.*"), "different-texts")
    places = texts.selectExpr("t1", "t2", "size(ws) as size", "inline(arrays_zip(pos, g))").selectExpr("*", f"pmod(t1, {SALT}) as salt")
    dealt = seeds.selectExpr("g", "k", "p", f"explode(sequence(0L, {SALT - 1}L)) as salt")
    pairs = places.join(dealt, ["g", "salt"]).groupBy("t1", "t2", "k").agg(F.max("size").alias("size"), F.collect_list(F.struct("pos", "p")).alias("found"))
    pairs = pairs.join(items.select("k", "m", "need"), "k").where("size(found) >= need")
    spans = pairs.select("t1", "t2", "k", "size", "m", "need", "found").mapInArrow(_placed, "t1 long, t2 int, k long, lo int, hi int")
    parts = spans.join(texts.select("t1", "t2", "ws"), ["t1", "t2"]).selectExpr("t1", "t2", "k", "lo", "slice(ws, lo + 1, hi - lo) as part")
    scored = parts.join(items.select("k", F.col("ws").alias("item")), "k").mapInArrow(_aligned, "t1 long, t2 int, k long, score double, begin long, end long")
    best = scored.groupBy("t1", "t2", "k").agg(F.max(F.expr("struct(score, -begin as b, end)")).alias("x")).selectExpr("t1", "t2", "k", "x.score", "-x.b as begin", "x.end")
    return seen.select("doc_id", "t1", "t2"), stored(best, "leaks"), ids


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, begin, end): the items each document leaks, and the words in it where the best copy lies."""
    found = _found(docs, benchmark)
    if found is None:
        return docs.limit(0).select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("end"))
    seen, best, ids = found
    return seen.join(best, ["t1", "t2"]).join(ids, "k").select("doc_id", "item_id", "score", "begin", "end")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    found = _found(docs, benchmark)
    if found is None:
        return docs
    leaked = found[1].selectExpr("t1 as l1", "t2 as l2").distinct()
    t1, t2 = _keys(F.col("doc.text"))
    rows = docs.select(F.struct("*").alias("doc")).withColumns({"t1": t1, "t2": t2})
    return rows.join(stored(leaked, "leaked-texts"), F.expr("t1 = l1 and t2 = l2"), "left_anti").select("doc.*")
