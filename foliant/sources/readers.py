"""Readers of inputs and of the tables between stages. All are lazy; paths may be any that Spark reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# Suffixes that are documents.
SUFFIXES = ["pdf", "png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp"]

WORDS = T.StructType([
    *[T.StructField(n, T.IntegerType()) for n in ("level", "page_num", "block_num", "par_num", "line_num", "word_num")],
    *[T.StructField(n, T.DoubleType()) for n in ("left", "top", "width", "height", "conf")],
    T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
])
BLOCKS = T.StructType([
    T.StructField("page_number", T.IntegerType()), T.StructField("block_number", T.IntegerType()), T.StructField("text", T.StringType()),
    *[T.StructField(n, T.DoubleType()) for n in ("x_start", "x_end", "y_start", "y_end", "confidence")],
    T.StructField("word_count", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("spatial_region", T.StringType()),
])


def inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder: (doc_id, path, name, suffix, modified, length, content). The id is a hash of the path, so equal names never meet."""
    files = spark.read.format("binaryFile").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    found = files.select(F.xxhash64("path").alias("doc_id"), "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), suffix.alias("suffix"), F.col("modificationTime").alias("modified"), "length", "content")
    return found.where(F.col("suffix").isin(*SUFFIXES))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The same without contents, by name."""
    return inputs(spark, folder).drop("content").orderBy(F.lower("name"), "path")


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Text files page_N_ocr.txt below a folder for each document: (doc_id, page_number, file, text)."""
    files = spark.read.text(f"{folder}/*/page_*_ocr.txt", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("doc_id"), F.regexp_extract("path", r"page_(\d+)_ocr\.txt$", 1).cast("int").alias("page_number"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "text")


def word_tables(spark: SparkSession, pattern: str) -> DataFrame:
    """CSV tables of words, one for each page; the page comes from the file's name, word_seq from the order in the file."""
    rows = spark.read.schema(WORDS).option("header", True).option("nullValue", "").csv(pattern)
    a = rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("doc_id"), F.regexp_extract("_metadata.file_path", r"page_(\d+)", 1).cast("int").alias("page_number"), F.monotonically_increasing_id().alias("word_seq"), "*")
    return a


def block_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of blocks; rows without geometry are dropped, missing sections are empty."""
    rows = spark.read.schema(BLOCKS).option("header", True).csv(path).dropna(subset=["x_start", "x_end", "y_start", "y_end"])
    return rows.fillna("", ["text", "section", "spatial_region"]).fillna(1, ["page_number"])


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table, or no rows where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def native_words(raw: DataFrame) -> DataFrame:
    """Words of a text layer, in points, to pixels of the page image: (x0, y0, x1, y1) scaled by image over page size; empty words go."""
    a = raw.withColumns({"kx": F.expr("image_width / page_width"), "ky": F.expr("image_height / page_height"), "text": tx.collapsed(F.col("text"))}).where("text != ''")
    return a.selectExpr("* except (kx, ky, x0, y0, x1, y1)", "double(rint(x0 * kx)) as left", "double(rint(y0 * ky)) as top", "double(greatest(0, rint((x1 - x0) * kx))) as width", "double(greatest(0, rint((y1 - y0) * ky))) as height", "100D as conf", "'native_pdf' as source")


def recognised(images: DataFrame, engine: Callable[[bytes], Iterator[dict]] | None = None) -> DataFrame:
    """Words of page images (doc_id, page_number, image), found by an engine on Python workers; the default needs pytesseract there.

    An image that fails gives one row with the reason in `error`, so a document that cannot be read does not stop the others.
    """
    schema = T.StructType([T.StructField("doc_id", images.schema["doc_id"].dataType), T.StructField("page_number", T.IntegerType()), T.StructField("word_seq", T.LongType()), *WORDS.fields, T.StructField("error", T.StringType())])

    def run(batches):
        import pandas as pd

        find = engine or tesseract
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                base = {f.name: None for f in schema} | {"doc_id": r.doc_id, "page_number": r.page_number}
                try:
                    rows += [base | {"word_seq": i} | w for i, w in enumerate(find(r.image), 1)]
                except Exception as e:  # noqa: BLE001  the reason goes into the row
                    rows.append(base | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=schema.names)

    return images.select("doc_id", F.col("page_number").cast("int").alias("page_number"), "image").mapInPandas(run, schema)


def tesseract(image: bytes) -> Iterator[dict]:
    import io

    import pytesseract
    from PIL import Image

    found = pytesseract.image_to_data(Image.open(io.BytesIO(image)), output_type=pytesseract.Output.DICT)
    for i, text in enumerate(found["text"]):
        if text.strip():
            yield {n: found[n][i] for n in ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf")} | {"text": text, "source": "tesseract"}


def recent(documents: DataFrame, n: int = 5) -> DataFrame:
    """The documents last changed: a report, so it is limited. kind names what they are for readers."""
    kind = F.when(F.upper("document_type") == "INVOICE", "Invoice").when(F.upper("document_type") == "RECEIPT", "Receipt").when(F.upper("document_type").isin("UNKNOWN", "GENERAL_DOCUMENT"), "Document").otherwise(F.initcap(F.replace(F.lower("document_type"), F.lit("_"), F.lit(" "))))
    return documents.withColumn("kind", kind).orderBy(F.desc("modified"), "doc_id").limit(n)
