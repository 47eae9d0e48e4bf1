"""Removal of repeated byte strings by bucket-pointer refinement of a sampled suffix array.

Suffixes that repeat LENGTH bytes share a bucket at every depth, so only suffixes in buckets of two or more need refining. Of each LENGTH-byte
string one suffix stands for it, its anchor: the Q-gram with the least hash among those inside, which equal strings choose alike. About one
position in a hundred is an anchor; each has the range of strings that chose it.

1. Initial buckets: anchors by the hash of their Q-gram. Buckets of one are done, nothing in their ranges repeats.
2. Anchors whose whole range of text is alike, too, repeat throughout. Of those one stands for all from here on.
3. What is left is refined: the range of string starts is halved again and again (LEVELS). A part stands for the bytes that all its strings have in common. Its bucket's
   identifier is made of the identifier that the part around it got in the round before, reused as it is, and of what stands at the further offsets, before and behind, that the
   smaller part has in common beyond it; no byte is read again that a bucket has in common. Buckets of one drop out in each round; at the last a part is one string, so two in a bucket are a repeat.

Buckets are counted by partial sums and joined, never gathered, and identifiers that many rows have are split, so a passage of any frequency is fine. The text is shuffled once; refinement
shuffles the few hundred bytes around anchors left over. Identifiers are 64-bit hashes. That is bucket-pointer refinement on a sample of suffixes, with sorted offsets taken from the sample: refining
all suffixes by doubling would shuffle a row for each byte of the corpus in each of nine rounds.

Defined results: a null or empty text has no bytes and nothing removed; texts shorter than LENGTH keep all; rows that repeat are repeats of each other;
documents with null ids take part; an empty table gives an empty result. Spans may cut a character; the kept bytes are then no valid UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, split_join, stored, sweep

LENGTH, Q = 400, 200
#: Lengths of the parts of a range, round by round.
LEVELS = (64, 8, 1)
#: Positions that are hashed at a time.
STRIP = 2**20

_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M2 = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.Generator(np.random.PCG64(400)).integers(0, 2**63, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p)


_UP, _DOWN = _powers(_M, STRIP + LENGTH + 1), _powers(_M_INVERSE, STRIP + LENGTH + 1)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from minima before and after the edges of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1), dtype=np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - width + 1
    return np.minimum(after[:k], before[width - 1 : width - 1 + k])


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """Arrays (h, f, at, lo, hi): of each anchor the hash of its Q-gram, that of the text of all its strings, its position, and the first and last start of its strings.

    Strips overlap, so a string lies whole in one; ranges end at strips' edges, which only divides them.
    """
    found = []
    for base in range(0, max(0, len(text) - LENGTH + 1), STRIP):
        part = np.frombuffer(text, dtype=np.uint8, count=min(STRIP + LENGTH - 1, len(text) - base), offset=base)
        n = len(part)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * _UP[:n], out=sums[1:])
        grams = _mixed((sums[Q:] - sums[:-Q]) * _DOWN[: n - Q + 1])
        best = _least((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), LENGTH - Q + 1)
        at = (best & _LOW).astype(np.int64)
        lo = np.flatnonzero(np.diff(at, prepend=-1))
        hi = np.append(lo[1:], len(at)) - 1
        at = at[lo]
        whole = (sums[hi + LENGTH] - sums[lo]) * _DOWN[lo]
        f = _mixed(whole + (at - lo).astype(np.uint64) * np.uint64(1000003) + (hi - lo).astype(np.uint64) * _M2)
        found.append((grams[at], f, at + base, lo + base, hi + base))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.empty(0, dtype=np.uint64 if i < 2 else np.int64) for i in range(5))


def _anchored(batches):
    for b in batches:
        k1, k2 = b.column("k1").to_numpy(zero_copy_only=False), b.column("k2").to_numpy(zero_copy_only=False)
        parts = [anchors(t.as_py() or b"") for t in b.column("t")]
        n = [len(p[0]) for p in parts]
        h, f, at, lo, hi = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, dtype=np.int64) for i in range(5))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(k1, n), pa.int64()), pa.array(np.repeat(k2, n), pa.int32()), pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (at, lo, hi))],
            names=["k1", "k2", "h", "f", "at", "lo", "hi"],
        )


def _refined(contexts: DataFrame) -> DataFrame:
    """(k1, k2, at, lo, ds) of open contexts: the offsets before an anchor at which strings begin that another context has, too.

    A strip's edge gives its anchor two ranges, so a context is known by its anchor and the start of its range.
    """
    names = ("k1", "k2", "at", "lo", "off", "least", "open", "text")
    live = contexts.selectExpr("k1", "k2", "at", "lo", "at - lo as off", "at - hi as least", "open", "text", "array(struct(0 as d, h as id)) as live")
    size = None
    for level in LEVELS:
        # What the bucket around has in common ends at `end`; the first one is the anchor's Q-gram.
        around, end = (size, f"off - x.d - {size} + {LENGTH + 1}") if size else (256, f"off + {Q}")
        parts = live.selectExpr(*names, "explode(live) as x").selectExpr(*names, "x", f"{end} as end", f"explode(sequence(0, {around // level - 1})) as k")
        parts = parts.selectExpr("*", f"x.d + k * {level} as d").where(f"d <= off and d + {level - 1} >= least")
        before, behind = f"substring(text, off - d + 1, k * {level})", f"substring(text, end + 1, greatest(0, off - d - {level} + {LENGTH + 1} - end))"
        parts = stored(parts.selectExpr("k1", "k2", "at", "lo", "open", "d", f"xxhash64(x.id, k, {before}, {behind}) as id"), "suffix-parts")
        # Parts of buckets with one that is open, and another one.
        shared = stored(parts.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.max("open").alias("any")).where("c > 1 and any").select("id", "c"), "suffix-buckets")
        kept = split_join(parts, shared.select("id"), "id", shared, "k1")
        size = level
        if level == 1:
            return kept.where("open").groupBy("k1", "k2", "at", "lo").agg(F.array_sort(F.collect_list("d")).alias("ds"))
        kept = kept.groupBy("k1", "k2", "at", "lo").agg(F.collect_list(F.struct("d", "id")).alias("live"))
        live = stored(live.drop("live").join(kept, ["k1", "k2", "at", "lo"]), "suffix-live")
        discard(parts, shared)


def _spans(sure: list[dict] | None, more: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Maximal runs [s, e) of bytes to remove."""
    runs = [(x["lo"], x["hi"] + LENGTH) for x in sure or []]
    for x in more or []:
        runs += [(x["at"] - d, x["at"] - d + LENGTH) for d in x["ds"]]
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return [(s, min(e, n)) for s, e in out]


def _cut(batches, whole: bool):
    for b in batches:
        rows = []
        for t, sure, more in zip(b.column("t"), b.column("sure"), b.column("more")):
            t = t.as_py()
            spans = _spans(sure.as_py(), more.as_py(), len(t))
            at, kept = 0, []
            for s, e in spans:
                kept.append(t[at:s])
                at = e
            kept = b"".join((*kept, t[at:]))
            rows.append((len(t), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept if whole else None))
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def cut(docs: DataFrame, whole: bool = True) -> DataFrame:
    """From rows (id, t), t the text as bytes: (id, n_bytes, n_removed, n_spans, kept_sha256, kept); kept, the bytes left, is null unless whole."""
    rows = docs.selectExpr("id", "coalesce(t, cast('' as binary)) as t").selectExpr("id", "t", "xxhash64(id, t) as k1", "hash(id, t) as k2")
    found = stored(rows.where(f"octet_length(t) >= {LENGTH}").select("k1", "k2", "t").mapInArrow(_anchored, "k1 long, k2 int, h long, f long, at int, lo int, hi int"), "anchors")
    shared = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared-grams")
    held = stored(split_join(found, shared.select("h"), "h", shared, "k1").selectExpr("k1", "k2", "h", "xxhash64(h, f) as f", "at", "lo", "hi"), "shared-anchors")
    discard(found, shared)
    sweep(docs.sparkSession)
    alike = held.groupBy("f").agg(F.first("h").alias("h"), F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "at")).alias("stands"))
    alike = stored(alike, "alike-anchors")
    kinds = alike.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least"))
    kinds = split_join(alike, kinds, "h", alike.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "f").drop("h")
    judged = split_join(held, kinds, "f", alike.select("f", "c"), "k1").selectExpr("k1", "k2", "h", "at", "lo", "hi", "c > 1 as sure", "kinds > 1 and least = 1 and (c = 1 or struct(k1, k2, at) = stands) as open")
    lists = judged.groupBy("k1", "k2").agg(
        F.collect_list(F.expr("if(sure, struct(lo, hi), null)")).alias("sure"),
        # Alike rows of one key stand once.
        F.collect_set(F.expr("if(open, struct(at, lo, hi, h, not sure as open), null)")).alias("contexts"),
    ).selectExpr("k1 as l1", "k2 as l2", "sure", "contexts")
    # The one shuffle of the text. What has no shared anchor is done and leaves its text behind.
    met = rows.join(lists, F.expr("k1 = l1 and k2 = l2"), "left").selectExpr(
        "id", "k1", "k2", "octet_length(t) as n", "sure", "contexts", "if(l1 is null, null, t) as t",
        "if(l1 is null, sha2(t, 256), null) as sha", "if(l1 is null, t, null) as kept" if whole else "cast(null as binary) as kept")
    met = stored(met, "met")
    near = met.where("size(contexts) > 0").selectExpr("k1", "k2", "t", "inline(contexts)").selectExpr("k1", "k2", "at", "lo", "hi", "h", "open", f"substring(t, lo + 1, hi - lo + {LENGTH}) as text")
    near = stored(near.dropDuplicates(["k1", "k2", "at", "lo"]), "contexts")
    refined = _refined(near).groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "ds")).alias("more")).selectExpr("k1 as r1", "k2 as r2", "more")
    touched = met.where("t is not null").join(refined, F.expr("k1 = r1 and k2 = r2"), "left").select("id", "t", "sure", "more")
    id_type = docs.schema["id"].dataType.simpleString()
    done = touched.mapInArrow(lambda bs: _cut(bs, whole), f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rest = met.where("t is null").selectExpr("id", "bigint(n) as n_bytes", "0L as n_removed", "0L as n_spans", "sha as kept_sha256", "kept")
    return done.unionAll(rest)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats) for each document; repeats tells whether anything was removed."""
    out = cut(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("t")), whole=False)
    return out.selectExpr("id as doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_removed > 0 as repeats")
