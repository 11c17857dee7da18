"""Uploaded files as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_TYPES = ("pdf", "docx")
MAX_BYTES = 5 * 1024 * 1024


def gate(path: Column, length: Column, types: tuple[str, ...] = FILE_TYPES,
         max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is refused; null when it is accepted."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(~extension.isin(*types), F.lit("unsupported type"))
        .when(length > max_bytes, F.lit("file too large"))
    )


def scan_files(spark: SparkSession, path: str, types: tuple[str, ...] = FILE_TYPES,
               max_bytes: int = MAX_BYTES) -> DataFrame:
    """File inventory: path, size, extension, SHA-256 of the bytes and the reason of a refusal.

    The bytes of refused files are never read: their part of the scan has no content column,
    and the size limit is pushed into the other part.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    refused = gate(F.col("path"), F.col("length"), types, max_bytes)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    head = [F.col("path"), F.col("length"), F.col("modificationTime"), extension.alias("extension")]
    good = files.filter((F.col("length") <= max_bytes) & refused.isNull()).select(
        *head, F.sha2("content", 256).alias("file_hash"), F.lit(None).cast("string").alias("reason"))
    bad = files.filter(refused.isNotNull()).select(
        *head, F.lit(None).cast("string").alias("file_hash"), refused.alias("reason"))
    return good.unionByName(bad)


def split_files(inventory: DataFrame, store: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Files whose hash is in ``store`` are rejected as stored already."""
    accepted = inventory.filter(F.col("reason").isNull())
    rejected = inventory.filter(F.col("reason").isNotNull())
    if store is None:
        return accepted, rejected
    known = store.select("file_hash").distinct()
    stored = accepted.join(known, "file_hash", "left_semi").withColumn("reason", F.lit("already stored"))
    return (
        accepted.join(known, "file_hash", "left_anti"),
        rejected.unionByName(stored),
    )
