"""Language-model scores from a hidden Markov model over word classes.

The base model is add-one unigram counts of all training documents. The hidden Markov model refines it: states emit classes of words, a class
emits its words by the base model, so log10 P(text) = base score + log10 of the forward likelihood of the classes relative to
their base probabilities. Classes: the most frequent words and the end have one each, other words share BUCKETS by their last
bytes. How many words have their own grows with the vocabulary: OWN_ROOT times its square root, and OWN at least. Any word has a class,
so held-out texts need no vocabulary on the workers.

Training is Baum-Welch: each task adds up expected counts over its documents, a shuffle adds up the tasks', and only those
sums, states x classes numbers, reach the driver between iterations. Tasks are TASKS for each core, so what is shuffled grows with the
classes and the cluster, not with the partitions of the corpus too. It reads every training document as one whole sequence.
Scoring runs the scaled forward recursion through whole texts.

Counts of words stay in a table. Words among the TOP most frequent, or all with an own class if those are more, are scored where the text is read (a broadcast
of words of at most WORD_BYTES bytes), all others by a join on the word's hash.

Defined results: a null or empty text has one token, its end; a null id counts as empty text when its checksum is taken; rows that repeat train
and score each; without training documents all words are unknown and the model is the base; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .tokens import ends, pieces

STATES, ITERATIONS = 6, 8
OWN, BUCKETS = 767, 256
#: Words with a class of their own, for each unit of the square root of the vocabulary.
OWN_ROOT = 8
#: Classes of a small vocabulary.
CLASSES = OWN + BUCKETS + 1
TOP, WORD_BYTES = 32768, 64
#: Tokens of the segments in which long texts are trained on side by side, and of the texts that are worked on at a time, one text more at most.
CHUNK, LOT = 512, 2**20
#: Training tasks for each core of the cluster.
TASKS = 2
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == HELD_OUT


def word_hash(word: bytes) -> int:
    """What Spark's xxhash64 makes of the bytes."""
    h = xxhash.xxh64_intdigest(word, seed=42)
    return h - 2**64 if h >= 2**63 else h


def own_words(types: int) -> int:
    """How many words of a vocabulary have a class of their own."""
    return max(OWN, OWN_ROOT * math.isqrt(types))


def class_type(classes: int) -> type:
    return np.uint16 if classes <= 2**16 else np.uint32


def _counted(batches):
    for b in batches:
        for _, words in pieces(b.column("t")):
            c: Counter = Counter()
            for ws in words:
                c.update(ws)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])


class Lexicon:
    """The most frequent words with their counts and classes, and the sizes of the training corpus."""

    def __init__(self, top: list[tuple[bytes, int]], tokens: int, types: int, documents: int):
        self.own = own_words(types)
        self.classes = self.own + BUCKETS + 1
        self.known = {w: (i if i < self.own else self.bucket(w)) for i, (w, _) in enumerate(top)}
        self.tokens, self.types, self.documents = tokens, types, documents
        self.total = np.log10(tokens + types + 1)
        self.score = {w: float(np.log10(c + 1) - self.total) for w, c in top}
        self.end = float(np.log10(documents + 1) - self.total)

    def bucket(self, word: bytes) -> int:
        return self.own + zlib.crc32(word[-3:]) % BUCKETS


class Numbers(dict):
    """Numbers keys in the order in which they are asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _taken_apart(batches, lexicon):
    """Rows with the classes of a text, its base score so far, and the words that the join must count."""
    lex = lexicon.value
    class_of, score_of = lex.known.get, lex.score.get
    kind = class_type(lex.classes)
    for b in batches:
        for start, words in pieces(b.column("t")):
            n, at, numbers = len(words), ends(words), Numbers()
            flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(at[-1]))
            text = np.repeat(np.arange(n), np.diff(at))
            # What each word of the piece is, worked out once.
            own = np.array([class_of(w, -1) for w in numbers], dtype=np.int64)
            score = np.array([score_of(w, 0.0) for w in numbers])
            rare, hashes = own < 0, np.zeros(len(own), dtype=np.uint64)
            for i, w in zip(np.flatnonzero(rare).tolist(), compress(numbers, rare.tolist())):
                own[i], hashes[i] = lex.bucket(w), xxhash.xxh64_intdigest(w, seed=42)
            # Classes of all texts, each with its end.
            classes = np.full(len(flat) + n, lex.classes - 1, dtype=kind)
            classes[np.arange(len(flat)) + text] = own[flat]
            late = rare[flat]
            late_of, times = np.unique(text[late] * len(own) + flat[late], return_counts=True)
            bounds = np.searchsorted(late_of, np.arange(n + 1) * len(own)).astype(np.int32)
            known = np.diff(at) - np.bincount(text[late], minlength=n) + (lex.documents > 0)
            cols = [
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(((at + np.arange(n + 1)) * classes.itemsize).astype(np.int32)), pa.py_buffer(classes)]),
                pa.array(np.diff(at) + 1, pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(lex.end + np.bincount(text, weights=score[flat], minlength=n)),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes[late_of % max(1, len(own))].view(np.int64))),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(times, pa.int32())),
                pa.array([xxhash.xxh3_128_digest(b" ".join(ws)) for ws in words], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, n), b.column("held_out").slice(start, n), *cols], names=["doc_id", "held_out", "classes", "n_tokens", "n_known", "base", "rare", "times", "same"])


class Model:
    """first (S), move (S, S) and ratio (S, classes): a state's emission of a class over the class's base probability."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray, base: np.ndarray):
        self.first, self.move, self.emit, self.base = first, move, emit, base
        self.ratio = emit / base

    @classmethod
    def start(cls, base: np.ndarray) -> Model:
        draw = np.random.Generator(np.random.PCG64(7))
        emit = base * draw.gamma(2.0, 0.5, (STATES, len(base)))
        move = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True), base)

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts (first, move, emit) over whole sequences of classes.

        Long ones are worked on in segments of CHUNK tokens side by side. What a segment does to the states before it is a matrix; a scan over the
        matrices of a text gives each of its segments the states that the text brings from before and after, so nothing is cut.
        """
        number = np.repeat(np.arange(len(texts)), [-(-len(x) // CHUNK) for x in texts])
        cut = [x[k : k + CHUNK] for x in texts for k in range(0, len(x), CHUNK)]
        length = np.array([len(c) for c in cut])
        order = np.argsort(-length, kind="stable")
        length, n, steps = length[order], len(cut), int(length.max())
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)  # where a segment, in the texts' order, stands by length
        live = np.searchsorted(-length, -np.arange(steps), side="left")
        at = np.concatenate(([0], np.cumsum(live)))
        padded = np.zeros((n, steps), dtype=np.int64)
        for i, k in enumerate(order):
            padded[i, : length[i]] = cut[k]
        flat = np.concatenate([padded[: live[t], t] for t in range(steps)])
        # States come first, so that each operation runs along the segments.
        moves = self.move.astype(np.float32)
        back = np.ascontiguousarray(moves.T)
        seen = np.take(self.ratio.astype(np.float32), flat, axis=1)
        opens = np.diff(number, prepend=-1) > 0
        enter, leave = np.repeat(self.first.astype(np.float32)[:, None], n, axis=1), np.ones((STATES, n), dtype=np.float32)
        if n > len(texts):
            self._scan(number, opens, place, live, at, seen, back, enter, leave)
        alpha, scale, a = np.empty_like(seen), np.empty(len(flat), dtype=np.float32), enter
        last = np.empty((STATES, n), dtype=np.float32)
        for t in range(steps):
            here, now = slice(at[t], at[t + 1]), live[t]
            a = (back @ a[:, :now] if t else a) * seen[:, here]
            s = a.sum(axis=0)
            a /= s
            alpha[:, here], scale[here] = a, s
            last[:, :now] = a
        beta = leave / (last * leave).sum(axis=0)
        opened = np.empty(n, dtype=bool)
        opened[place] = opens
        move = np.zeros((STATES, STATES))
        for t in range(steps - 1, -1, -1):
            here, now = slice(at[t], at[t + 1]), live[t]
            ahead = seen[:, here] * beta[:, :now]
            ahead /= scale[here]
            alpha[:, here] *= beta[:, :now]  # from here on the states' shares
            if t:
                move += alpha[:, at[t - 1] : at[t - 1] + now] @ ahead.T
                beta[:, :now] = moves @ ahead
            else:
                before = np.flatnonzero(~opens)
                move += last[:, place[before - 1]] @ ahead[:, place[before]].T
        emit = np.stack([np.bincount(flat, weights=x, minlength=len(self.base)) for x in alpha])
        return alpha[:, :n][:, opened].sum(axis=1, dtype=np.float64), move * self.move, emit

    def _scan(self, number, opens, place, live, at, seen, back, enter, leave) -> None:
        """Fills enter, the states expected at the first token of each segment, and leave, what follows its last one says of them."""
        many = np.flatnonzero(np.bincount(number)[number] > 1)  # segments of texts with several
        spot = np.sort(place[many])
        product = np.empty((STATES, STATES, len(spot)), dtype=np.float32)  # to each state, from each state, of each segment
        run = np.repeat(np.eye(STATES, dtype=np.float32)[:, :, None], len(spot), axis=2)
        for t in range(len(live)):
            k = int(np.searchsorted(spot, live[t]))
            if k < run.shape[2]:
                product[:, :, k : run.shape[2]] = run[:, :, k:]
                run = np.ascontiguousarray(run[:, :, :k])
            if not k:
                break
            if t:
                run = (back @ run.reshape(STATES, -1)).reshape(run.shape)
            run *= seen[:, at[t] + spot[:k]][:, None, :]
            if t % 4 == 3:  # four steps stay within the range of a float
                run /= run.max(axis=(0, 1))
        product[:, :, : run.shape[2]] = run
        of = np.empty(len(place), dtype=np.int64)
        of[spot] = np.arange(len(spot))
        first = np.flatnonzero(opens)
        count = np.diff(np.append(first, len(number)))
        for k in range(1, int(count.max())):
            x = first[count > k] + k
            a = self.move.T @ np.einsum("in,jin->jn", enter[:, place[x - 1]], product[:, :, of[place[x - 1]]], dtype=np.float64)
            enter[:, place[x]] = a / a.sum(axis=0)
        for k in range(int(count.max()) - 1, 0, -1):
            x = first[count > k] + k
            b = self.move @ np.einsum("jin,jn->in", product[:, :, of[place[x]]], leave[:, place[x]], dtype=np.float64)
            leave[:, place[x - 1]] = b / b.sum(axis=0)

    def updated(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """From summed counts; a little of the base in each emission keeps every class possible in every state."""
        share = lambda c, prior: (c + prior) / (c + prior).sum(axis=-1, keepdims=True)
        return Model(share(first, 0.1), share(move, 0.1), share(emit, 50 * self.base / self.base.sum()), self.base)

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of the likelihood of each sequence of classes over its base probability: the scaled forward recursion, of many texts at a time."""
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        length = np.array([len(texts[i]) for i in order])
        if not len(length):
            return out
        flat, at = np.concatenate([texts[i] for i in order]), np.concatenate(([0], np.cumsum(length)[:-1]))
        a, total, r = np.tile(self.first, (len(order), 1)), np.zeros(len(order)), self.ratio.T
        live = len(order)
        for t in range(int(length[0])):
            while length[live - 1] <= t:
                live -= 1
            a = a[:live]
            if t:
                a = a @ self.move
            a = a * r[flat[at[:live] + t]]
            s = a.sum(axis=1)
            a /= s[:, None]
            total[:live] += np.log10(s)
        out[order] = total
        return out


def _expected(batches, model):
    """One row of summed counts for a partition."""
    m = model.value
    sums, held, size = None, [], 0

    def add():
        nonlocal sums
        counts = np.concatenate([v.ravel() for v in m.expected(held)])
        sums = counts if sums is None else sums + counts

    for b in batches:
        for v in b.column("classes"):
            held.append(np.frombuffer(v.as_py(), dtype=class_type(len(m.base))))
            size += len(held[-1])
            if size >= LOT:
                add()
                held, size = [], 0
    if held:
        add()
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])


def _forward(batches, model):
    m = model.value
    for b in batches:
        names = [n for n in b.schema.names if n != "classes"]
        for k in range(0, b.num_rows, 2048):
            part = b.slice(k, 2048)
            gain = m.log10([np.frombuffer(v.as_py(), dtype=class_type(len(m.base))) for v in part.column("classes")])
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(gain)], names=[*names, "gain"])


def lexicon_of(docs: DataFrame) -> tuple[DataFrame, Lexicon, np.ndarray]:
    """The stored table of word counts (h, c), the lexicon, and the base probability of each class, from rows (t) of training texts."""
    counts = docs.select("t").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = stored(counts.withColumn("h", F.xxhash64("word")), "word-counts")
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    documents = docs.count()
    types_all = types + (documents > 0)
    most = max(TOP, own_words(types_all))
    # The count that more than `most` words reach is found first, so that no more words come to the driver.
    short = counts.where(F.octet_length("word") <= WORD_BYTES)
    least = short.groupBy("c").agg(F.count(F.lit(1)).alias("n")).selectExpr("c", "sum(n) over (order by c desc) as upto").where(f"upto > {most}").agg(F.max("c")).first()[0] or 0
    top = sorted(((bytes(x.word), x.c) for x in short.where(F.col("c") > least).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))
    lex = Lexicon(top, tokens + documents, types_all, documents)
    # Base probability of the classes: what their words have, one unknown word in each bucket included.
    low = counts.selectExpr(f"pmod(crc32(substring(word, greatest(1, length(word) - 2), 3)), {BUCKETS}) as k", "c + 1 as c", "word")
    shared = {r.k: r.c for r in low.groupBy("k").agg(F.sum("c").alias("c")).collect()}
    base = np.ones(lex.classes)
    for i, (_, c) in enumerate(top[: lex.own]):
        base[i] += c
    for k in range(BUCKETS):
        base[lex.own + k] += shared.get(k, 0)
    for w, c in top[: lex.own]:
        base[lex.bucket(w)] -= c + 1
    base[-1] += documents
    return counts, lex, base / (lex.tokens + lex.types + 1)


def trained(seen: DataFrame, base: np.ndarray, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over the classes of the training rows of seen."""
    spark = seen.sparkSession
    model = Model.start(base)
    train = seen.where("not held_out").select("classes").coalesce(TASKS * spark.sparkContext.defaultParallelism)
    for _ in range(iterations):
        held = spark.sparkContext.broadcast(model)
        parts = train.mapInArrow(lambda bs, held=held: _expected(bs, held), "sums array<double>")
        sums = parts.selectExpr("posexplode(sums) as (i, v)").where("v != 0").groupBy("i").agg(F.sum("v").alias("v")).collect()
        if not sums:
            break
        flat = np.zeros(STATES + STATES**2 + STATES * len(base))
        for r in sums:
            flat[r.i] = r.v
        first, move, emit = np.split(flat, [STATES, STATES + STATES**2])
        model = model.updated(first, move.reshape(STATES, STATES), emit.reshape(STATES, len(base)))
    return model


def scored(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("t"))
    counts, lex, base = lexicon_of(rows.where("not held_out"))
    held = spark.sparkContext.broadcast(lex)
    id_field = rows.schema["doc_id"]
    schema = T.StructType([id_field, T.StructField("held_out", T.BooleanType()), T.StructField("classes", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("same", T.BinaryType())])
    seen = stored(rows.mapInArrow(lambda bs: _taken_apart(bs, held), schema), "classes")
    # Words beyond the lexicon: counted by a join; texts of the same words (no word holds the space that joins them) share the hash `same`, so their sums are divided again.
    words = seen.selectExpr("same", "n_tokens as size", "inline(arrays_zip(rare, times))").selectExpr("same", "size", "rare as h", "times")
    found = words.join(counts.select("h", "c"), "h", "left")
    late = found.groupBy("same", "size").agg(F.sum(F.expr(f"times * (log10(coalesce(c, 0L) + 1D) - {float(lex.total)!r}D)")).alias("late"), F.sum(F.expr("if(c is null, 0, times)")).alias("late_known"))
    alike = seen.groupBy("same", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    late = alike.join(late.selectExpr("same", "size as n_tokens", "late", "late_known"), ["same", "n_tokens"]).selectExpr("same as l_same", "n_tokens as l_size", "late / copies as late", "late_known div copies as late_known")
    model = spark.sparkContext.broadcast(trained(seen, base, iterations))
    kept = T.StructType([f for f in schema if f.name not in ("classes", "rare", "times")] + [T.StructField("gain", T.DoubleType())])
    gains = seen.drop("rare", "times").mapInArrow(lambda bs: _forward(bs, model), kept)
    both = gains.join(late, F.expr("same = l_same and n_tokens = l_size"), "left")
    score = "base + coalesce(late, 0D)"
    return both.selectExpr("doc_id", "held_out", "n_tokens", "n_known + coalesce(late_known, 0L) as n_known", f"{lex.tokens}L as train_tokens", f"{score} as base_score", f"{score} + gain as score")
