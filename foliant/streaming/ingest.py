"""Streams: documents as they land, and progress as a console tells it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify


def landing(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Text files of a folder as a stream of documents (doc_id, path, text, arrived)."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return rows.select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def classified(stream: DataFrame) -> DataFrame:
    """The stream with its classes and routes: a projection, so it needs no state."""
    return classify.routed(classify.classified(stream))


def counts(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Documents by class and hour of arrival; state older than the watermark goes."""
    return classified(stream).withWatermark("arrived", late).groupBy(F.window("arrived", window), "document_type").agg(F.count(F.lit(1)).alias("n"))


def progress(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(job, stage, percent, label): how far each job came, from console lines (job, ts, text)."""
    seen = classify.progress(lines).where("stage is not null").withWatermark("ts", late)
    return seen.groupBy("job").agg(F.max(F.struct("percent", "stage", "label")).alias("m")).select("job", "m.stage", "m.percent", "m.label")


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every batch to a function once; a restart continues from the checkpoint."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
