"""Readings of a page against folds that compare all words with all."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import quality, readings
from foliant.plans import q_quality

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, page_number int, word_seq long, left double, top double, width double, height double, conf double, text string"
FIELDS = ("left", "top", "width", "height", "conf", "text")


def _share(a, b):
    w = min(a["left"] + a["width"], b["left"] + b["width"]) - max(a["left"], b["left"])
    h = min(a["top"] + a["height"], b["top"] + b["height"]) - max(a["top"], b["top"])
    return 0.0 if w <= 0 or h <= 0 else w * h / max(a["width"] * a["height"] + b["width"] * b["height"] - w * h, 1.0)


def _merged(base, other):
    rows = [dict(r) for r in sorted(base, key=lambda r: r["word_seq"])]
    bands = [r["top"] // 80 for r in rows]
    for new in sorted(other, key=lambda r: r["word_seq"]):
        for i, old in enumerate(rows):
            share, a, b = _share(old, new), readings.key(new["text"]), readings.key(old["text"])
            if abs(bands[i] - new["top"] // 80) <= 1 and share >= 0.45 and (share >= 0.78 or a == b or (min(len(a), len(b)) >= 4 and share >= 0.60 and readings.similarity(a, b) >= 0.78)):
                if new["conf"] > old["conf"] + 5:
                    rows[i] = dict(new)
                break
        else:
            rows.append(dict(new))
            bands.append(new["top"] // 80)
    return [tuple(r[c] for c in FIELDS) for r in rows]


def _voted(base, frames):
    out = {}
    for word in base:
        votes = [(0, word)]
        for f, frame in enumerate(frames, 1):
            near = []
            for b in frame:
                apart = ((word["left"] + word["width"] / 2 - b["left"] - b["width"] / 2) ** 2 + (word["top"] + word["height"] / 2 - b["top"] - b["height"] / 2) ** 2) ** 0.5
                share = _share(word, b)
                if share > 0 and b["text"].strip(" ") and (share >= 0.30 or apart <= 1.5 * max(8, word["height"], b["height"])):
                    near.append((share, -b["word_seq"], b))
            votes += [(f, max(near, key=lambda n: n[:2])[2])] if near else []
        tally = {}
        for f, b in votes:
            if k := readings.key(b["text"]):
                tally.setdefault(k, []).append((f, b))
        ranked = max(((len(v), sum(max(b["conf"], 0) for _, b in v), -v[0][0], k) for k, v in tally.items()), default=(0,))
        change = ranked[0] >= 2 and ranked[3] != readings.key(word["text"])
        out[word["word_seq"]] = max(((len(b["text"]), -f, b["text"]) for f, b in tally[ranked[3]]))[2] if change else word["text"]
    return out


def _frame(rng, n, big):
    texts = ["total", "Total", "tota1", "totals", "sum", "s-um", "", " ", "x", "Invoice", "invoices", "--"]
    return [{"word_seq": i, "left": float(rng.randrange(0, 260)), "top": float(rng.randrange(0, 200)), "width": float(rng.choice([0, 12, 40, 60, 4000 if big else 50])), "height": float(rng.choice([18, 20, 24, 300 if big else 22])), "conf": float(rng.randrange(-5, 100)), "text": rng.choice(texts)} for i in rng.sample(range(1, 4 * n), n)]


@pytest.mark.parametrize("limits", [None, (8, 16, 4)])
def test_readings_equal_brute_force(spark, monkeypatch, limits):
    """On dense pages, so that words share partners, chains arise and some words are larger than all others; also with pieces so small that pages and pairs are cut, and all large words are met singly."""
    rng = random.Random(5)
    pages = {(d, 1 + d % 2): (_frame(rng, 40, d % 3 == 0), _frame(rng, 35, d % 3 == 0), _frame(rng, 30, d % 4 == 0)) for d in range(30)}
    pages[(100, 1)] = ([], _frame(rng, 10, False), [])
    pages[(101, 1)] = (_frame(rng, 10, False), [], [])
    frames = [spark.createDataFrame([(d, p, *(w[c] for c in ("word_seq", *FIELDS))) for (d, p), fs in pages.items() for w in fs[k]], SCHEMA) for k in range(3)]
    if limits:
        got_m, got_v = _local(monkeypatch, limits, frames)
    else:
        got_m = quality.merged(frames[0], frames[1]).collect()
        got_v = quality.consensus(*frames).collect()
    merged, voted = {}, {}
    for r in sorted(got_m, key=lambda r: r["word_seq"]):
        merged.setdefault((r["doc_id"], r["page_number"]), []).append(tuple(r[c] for c in FIELDS))
    for r in got_v:
        voted.setdefault((r["doc_id"], r["page_number"]), {})[r["word_seq"]] = r["text"]
    for page, (base, other, third) in pages.items():
        assert merged.get(page, []) == _merged(base, other), page
        assert voted.get(page, {}) == _voted(base, [other, third]), page


def _local(monkeypatch, limits, frames):
    """The same folds in this process, where their limits can be set."""
    for name, value in zip(("ROWS", "PAIRS", "CELLS"), limits, strict=True):
        monkeypatch.setattr(readings, name, value)
    out = []
    for fold, rows in ((readings.merged, readings.beside(*frames[:2])), (readings.voted, readings.beside(*frames))):
        held, seen = {}, []
        with monkeypatch.context() as m:
            m.setattr(type(rows), "mapInArrow", lambda self, run, schema: held.update(run=run, rows=self) or rows.withColumns({}))
            fold(rows)
        for batch in held["run"](iter(held["rows"].toArrow().to_batches(max_chunksize=7))):
            seen += batch.to_pylist()
        out.append(seen)
    return out


@pytest.mark.parametrize("query", ["ocr_consensus", "ocr_merge"])
def test_no_word_is_shuffled(spark, query):
    """Texts are dealt by document once; what else is shuffled is counts of documents. Words are sorted once."""
    plan = q_quality.QUERIES[query](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == (1 if query == "ocr_consensus" else 2)
    assert plan.count("Sort [") == 1 and "Join" not in plan and "FlatMapGroups" not in plan


def test_long_line(spark):
    """Work follows the words that meet, not all pairs of a line: all pairs of these take minutes."""
    n = 20000
    base = spark.range(n).selectExpr("1L as doc_id", "1 as page_number", "id + 1 as word_seq", "id * 80D as left", "0D as top", "60D as width", "20D as height", "50D as conf", "concat('word', id) as text")
    other = base.withColumns({"left": F.col("left") + 2, "conf": F.lit(80.0)})
    began = time.time()
    assert quality.merged(base, other).where("conf = 80").count() == n
    assert time.time() - began < 30
