"""Sinks: tables partitioned by document, CSV with fixed columns, JSON, and workbooks where openpyxl is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that lead in the table of regions.
REGION_COLUMNS = ["page_number", "block_number", "text", "section", "spatial_region", "x_start", "x_end", "y_start", "y_end", "confidence", "word_count"]
# What a finished document offers for download.
ARTIFACTS = ["generic_final.json", "final_invoice_data.json", "invoice_data.json", "invoice_output.csv", "invoice_output.xlsx", "validation_report.json"]


def workspace(df: DataFrame, path: str, *by: str, form: str = "parquet") -> None:
    """Writes documents over what they had before; other documents in the folder stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).format(form).partitionBy(*(by or ("doc_id",))).save(path)


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def regions_csv(df: DataFrame, path: str) -> None:
    lead = [c for c in REGION_COLUMNS if c in df.columns]
    csv(df, path, lead + [c for c in df.columns if c not in lead])


def json(df: DataFrame, path: str) -> None:
    """One object to a line, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def texts(df: DataFrame, path: str) -> None:
    """One file of text for each document and page."""
    df.select("doc_id", "page_number", "text").write.mode("overwrite").partitionBy("doc_id", "page_number").text(path, lineSep="\n")


def diagnostics(candidates: DataFrame) -> DataFrame:
    """(doc_id, page_number, text): the candidates of a page as lines, best first."""
    line = F.format_string("%s | confidence %.2f | score %.2f", "variant", F.col("confidence").cast("double"), F.col("score").cast("double"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "variant", line.alias("line"))))
    return candidates.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def downloads(files: DataFrame) -> DataFrame:
    """(doc_id, artifact, there) from (doc_id, name): which downloads of a document exist."""
    docs = files.select("doc_id").distinct()
    wanted = docs.withColumn("artifact", F.explode(F.array(*[F.lit(a) for a in ARTIFACTS])))
    return wanted.join(files.select("doc_id", F.col("name").alias("artifact"), F.lit(True).alias("there")).distinct(), ["doc_id", "artifact"], "left").fillna(False, ["there"])


def workbook(sheets: dict[str, DataFrame], path: str, widths: dict[str, dict[str, int]] | None = None, rows: int = 1_000_000) -> None:
    """One document's sheets as a workbook, written by the driver row by row; a sheet holds no more than `rows` rows, as the format does."""
    from openpyxl import Workbook
    from openpyxl.utils import get_column_letter

    book = Workbook(write_only=False)
    book.remove(book.active)
    for name, df in sheets.items():
        sheet = book.create_sheet(name)
        sheet.freeze_panes = "A2"
        sheet.append(df.columns)
        for i, r in enumerate(df.toLocalIterator()):
            if i == rows:
                raise ValueError(f"{name} has more rows than a sheet holds")
            sheet.append(list(r))
        for i, c in enumerate(df.columns, 1):
            sheet.column_dimensions[get_column_letter(i)].width = (widths or {}).get(name, {}).get(c, 12)
    book.save(path)
