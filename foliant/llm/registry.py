"""The queries of this subpackage, one for each operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, jaccard, lm, mixing, pages, pii, quality, sharding, suffixes, urls
from .common import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda spark, d: read(spark, d, "documents")
    return {
        "op1_pii": lambda spark, d: pii.digest(docs(spark, d)),
        "op2_quality": lambda spark, d: quality.assess(docs(spark, d)),
        "op3_url_filter": lambda spark, d: urls.judged(read(spark, d, "pages")),
        "op4_decontamination": lambda spark, d: decontam.matches(docs(spark, d), read(spark, d, "benchmark")),
        "op5_html_extraction": lambda spark, d: pages.extracted(read(spark, d, "pages")),
        "op6_suffix_dedup": lambda spark, d: suffixes.deduplicated(docs(spark, d)),
        "op7_mixing": lambda spark, d: mixing.mixture(docs(spark, d)),
        "op8_sharding": lambda spark, d: sharding.sharded(docs(spark, d)),
        "op9_jaccard_join": lambda spark, d: jaccard.joined(docs(spark, d)),
        "op10_lm_scoring": lambda spark, d: lm.scored(docs(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": pii.ORACLE_SQL, "op2_quality": quality.ORACLE_SQL}
