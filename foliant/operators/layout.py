"""From words to lines to blocks to sections, page by page.

Every window and aggregate keys on (doc_id, page_number), so one exchange serves them all and pages never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import lower_key

PAGE = ["doc_id", "page_number"]
#: Words that a fold takes in one go; flags of a page are kept in pieces of that many, so long pages stay linear.
PIECE = 256


def cleaned(words: DataFrame) -> DataFrame:
    """Words with text and possible geometry; null confidence is 0, low confidence stays. Adds right, bottom, center_x, center_y."""
    a = words.withColumn("text", F.trim(F.regexp_replace("text", " ", " "))).where("text != ''")
    if "conf" not in a.columns:
        a = a.withColumn("conf", F.lit(0.0))
    a = a.withColumns({c: F.col(c).cast("double") for c in ("left", "top", "width", "height", "conf")})
    a = a.dropna(subset=["left", "top", "width", "height"]).where("width > 0 and height > 0 and left >= 0 and top >= 0").fillna({"conf": 0.0})
    return a.withColumns({"right": F.expr("left + width"), "bottom": F.expr("top + height"), "center_x": F.expr("left + width / 2"), "center_y": F.expr("top + height / 2")})


def thresholds(words: DataFrame) -> DataFrame:
    """(doc_id, page_number, y_tolerance, x_gap): how far apart words of a line and of a block may be, by the page's median word."""
    size = words.groupBy(*PAGE).agg(F.coalesce(F.median(F.expr("if(height > 0, height, null)")), F.lit(40.0)).alias("h"), F.coalesce(F.median(F.expr("if(width > 0, width, null)")), F.lit(60.0)).alias("w"))
    return size.select(*PAGE, F.expr("greatest(6D, least(24D, h * 0.3D))").alias("y_tolerance"), F.expr("greatest(45D, least(180D, greatest(h * 1.4D, w * 1.25D)))").alias("x_gap"))


def _line_flags() -> str:
    """SQL: for the sorted array `ws` (cy2, ...), 1 where a word opens a line. A word joins while its doubled centre is within 2 * tol of the line's mean.

    The mean is kept as sum and count, so whole numbers stay exact.
    """
    step = "if(s.n > 0 and abs(x.cy2 * s.n - s.sum) <= 2 * tol * s.n, named_struct('sum', s.sum + x.cy2, 'n', s.n + 1, 'flags', concat(s.flags, array(0))), named_struct('sum', x.cy2, 'n', 1L, 'flags', concat(s.flags, array(1))))"
    inner = f"aggregate(slice(ws, int(k * {PIECE} + 1), {PIECE}), named_struct('sum', o.sum, 'n', o.n, 'flags', cast(array() as array<int>)), (s, x) -> {step})"
    outer = f"transform(array({inner}), i -> named_struct('sum', i.sum, 'n', i.n, 'all', concat(o.all, array(i.flags))))[0]"
    return f"flatten(aggregate(sequence(0, (size(ws) - 1) div {PIECE}), named_struct('sum', 0D, 'n', 0L, 'all', cast(array() as array<array<int>>)), (o, k) -> {outer}).all)"


def lines(words: DataFrame) -> DataFrame:
    """Adds line, numbered from 1 on each page, to cleaned words; ordered by centre, then left, then word_seq."""
    keep = [c for c in words.columns if c not in PAGE]
    packed = words.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.struct((F.col("center_y") * 2).alias("cy2"), F.col("left").alias("l"), F.col("word_seq").alias("q"), F.struct(*keep).alias("w")))).alias("ws"),
        F.coalesce(F.median(F.expr("if(height > 0, height, null)")), F.lit(40.0)).alias("h"),
    ).withColumn("tol", F.expr("greatest(6D, least(24D, h * 0.3D))"))
    flagged = packed.withColumn("flags", F.expr(_line_flags())).select(*PAGE, F.posexplode(F.expr("transform(ws, (x, i) -> struct(x.w as w, flags[i] as f))")).alias("i", "x"))
    return flagged.selectExpr(*PAGE, "x.w.*", "cast(sum(x.f) over (partition by doc_id, page_number order by i) as int) as line")


def chunks(lined: DataFrame) -> DataFrame:
    """Adds chunk: a line is cut where the gap to the word before, by that word's right end, is more than the page allows."""
    a = lined.selectExpr("*", "greatest(45D, least(180D, greatest(1.4D * coalesce(median(if(height > 0, height, null)) over (partition by doc_id, page_number), 40D), 1.25D * coalesce(median(if(width > 0, width, null)) over (partition by doc_id, page_number), 60D)))) as x_gap",
                         "lag(right) over (partition by doc_id, page_number, line order by left, center_y, word_seq) as before")
    return a.selectExpr("* except (x_gap, before)", "cast(sum(if(left - before > x_gap, 1, 0)) over (partition by doc_id, page_number, line order by left, center_y, word_seq) as int) as chunk")


def blocks(words: DataFrame) -> DataFrame:
    """Blocks of cleaned words: (doc_id, page_number, block_number, text, x_start, x_end, y_start, y_end, confidence, word_count)."""
    cut = chunks(lines(words))
    rolled = cut.groupBy(*PAGE, "line", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "center_y", "word_seq", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.round(F.min("left"), 2).alias("x_start"), F.round(F.max("right"), 2).alias("x_end"), F.round(F.min("top"), 2).alias("y_start"), F.round(F.max("bottom"), 2).alias("y_end"),
        F.round(F.avg("conf"), 2).alias("confidence"), F.count(F.lit(1)).cast("int").alias("word_count"),
    )
    return rolled.selectExpr(*PAGE, "cast(row_number() over (partition by doc_id, page_number order by y_start, x_start, line, chunk) as int) as block_number", "text", "x_start", "x_end", "y_start", "y_end", "confidence", "word_count")


def paged(rows: DataFrame) -> DataFrame:
    """(doc_id, page_number, blocks): rows as an array for each page, in no order."""
    return rows.groupBy(*PAGE).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in PAGE])).alias("blocks"))


def unpaged(pages: DataFrame) -> DataFrame:
    # Of inline() the optimizer infers a filter on the array and pushes it down, where it works out all that made the array once more; of an outer generator it does not.
    return pages.select(*PAGE, F.posexplode_outer("blocks").alias("i", "x")).where("i is not null").select(*PAGE, "x.*")


def names(pages: DataFrame) -> list[str]:
    """What a page's blocks hold."""
    return pages.schema["blocks"].dataType.elementType.names


def section(text: Column) -> Column:
    """The section that a block's own text names; the first in order of precedence, else empty."""
    return _section(lower_key(text))


def _section(low: Column) -> Column:
    found = F.lit("")
    for name, words in reversed(rules.SECTIONS):
        if isinstance(words, str):
            hit = low.rlike(words)
        else:
            hit = F.lit(False)
            for w in words:
                hit = hit | low.contains(w)
        found = F.when(hit, name).otherwise(found)
    return found


def sectioned(blocks_: DataFrame) -> DataFrame:
    return blocks_.withColumn("section", section(F.col("text")))


def sectioned_pages(pages: DataFrame) -> DataFrame:
    """The same for pages of blocks."""
    own = names(pages)
    # Nothing is shared inside a lambda, so the text is folded in a step of its own.
    low = F.transform("blocks", lambda x: F.struct(x.alias("x"), lower_key(x["text"]).alias("low")))
    return pages.withColumn("blocks", F.transform(low, lambda z: F.struct(*[z["x"][n].alias(n) for n in own], _section(z["low"]).alias("section"))))


def page_files(blocks_: DataFrame, kind: str) -> DataFrame:
    """The three outputs of a document's blocks: page (by page), all, and first, the page that older readers know."""
    return blocks_.where("page_number = 1") if kind == "first" else blocks_
