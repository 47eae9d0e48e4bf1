"""Document classes from weighted patterns, and the routes that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import upper_key


def _hits(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """The patterns that match, in rule order, with their weights; each counts once."""
    rule = [F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"))) for p, w in patterns]
    return F.filter(F.array(*rule), lambda x: x.isNotNull())


def documents(pages: DataFrame, text: str = "text") -> DataFrame:
    """From pages (doc_id, page_number, text): (doc_id, text), the pages of a document in order."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def classified(docs: DataFrame) -> DataFrame:
    """Adds scores, evidence (structs by class), document_type and confidence to rows with a text."""
    a = docs.withColumn("c_text", upper_key(F.col("text")))
    a = a.withColumns({f"c_{k}": _hits(F.col("c_text"), v) for k, v in rules.CLASSES.items()})
    total = lambda k: F.aggregate(f"c_{k}", F.lit(0), lambda s, x: s + x["w"])
    a = a.withColumn("scores", F.struct(*[total(k).alias(k) for k in rules.CLASSES]))
    a = a.withColumn("evidence", F.struct(*[F.transform(f"c_{k}", lambda x: x["p"]).alias(k) for k in rules.CLASSES]))
    # The two best; between equal scores none is chosen, so their order does not matter.
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"scores.{k}").alias("s"), F.lit(k).alias("k")) for k in rules.CLASSES])))
    a = a.withColumn("c_best", ranked[0]).withColumn("c_lead", ranked[0]["s"] - ranked[1]["s"])
    known = (F.col("c_best.s") > 0) & (F.col("c_lead") > 0)
    sure = F.lit(55)
    for score, lead, confidence in reversed(rules.CONFIDENCE):
        sure = F.when((F.col("c_best.s") >= score) & (F.col("c_lead") >= lead), confidence).otherwise(sure)
    a = a.withColumn("document_type", F.when(known, F.col("c_best.k")).otherwise("UNKNOWN")).withColumn("confidence", F.when(known, sure).otherwise(0))
    return a.drop("c_text", "c_best", "c_lead", *[f"c_{k}" for k in rules.CLASSES])


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def routed(docs: DataFrame) -> DataFrame:
    """Adds the two routes of a classified document, which can disagree: batch wants a vendor marker, upload the vendor's name and any sign of an invoice."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    invoice = F.col("document_type") == "INVOICE"
    return docs.withColumns({
        "route_batch": F.when(invoice & _any(low, rules.BATCH_MARKERS), "structured").otherwise("generic"),
        "route_upload": F.when(invoice & low.contains(rules.UPLOAD_VENDOR) & _any(low, rules.UPLOAD_MARKERS), "structured").otherwise("generic"),
    })


def progress(lines: DataFrame) -> DataFrame:
    """Adds stage, percent and label of a console line; null for lines that say nothing of the progress."""
    low = F.lower(F.col("text"))
    stage = percent = name = F.lit(None)
    for ways, s, p, label in reversed(rules.PROGRESS):
        hit = F.lit(False)
        for parts in ways:
            all_of = F.lit(True)
            for w in parts:
                all_of = all_of & low.contains(w)
            hit = hit | all_of
        stage, percent, name = F.when(hit, s).otherwise(stage), F.when(hit, p).otherwise(percent), F.when(hit, label).otherwise(name)
    return lines.withColumns({"stage": stage, "percent": percent, "label": name})
