"""Readers: parquet tables by name, document JSON, and files by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.schema import DOCUMENT


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents as JSON lines under the fixed schema (SRC7): absent optional fields are null, and a line that is not
    JSON gives a row whose `_corrupt` holds it, so nothing is lost silently."""
    return spark.read.schema(f"{DOCUMENT}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def binary_files(spark: SparkSession, path: str, max_bytes: int = 40 << 20) -> DataFrame:
    """Files of at most max_bytes with path, length and content (SRC1); larger ones are not read into memory, since
    the length filter is pushed into the scan."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= max_bytes)


def input_kind(path: Column, mime: Column) -> Column:
    """pdf, image or other by MIME type, else by extension (SRC5). A null path and null MIME give other."""
    p, m = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when((m == "application/pdf") | p.endswith(".pdf"), "pdf")
        .when(m.startswith("image/") | p.rlike(r"\.(png|jpe?g|webp|heic|heif|bmp|tiff?)$"), "image")
        .otherwise("other")
    )
