"""Stored tables: snapshots in Parquet, and an existing relational store over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a new folder and read it back; a folder that exists is never replaced.

    Rebuilding a table always reads the old snapshot, so replacing it in place would lose rows
    when a task is retried.
    """
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, for plans that use it several times."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sorted_in(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join, never broadcast.

    Spark estimates a side from the compressed size of its files and counts one entry for each array, so texts, lists and
    exploded rows derived from a small file look far smaller than they are, and a broadcast of them fills the driver.
    """
    return df.hint("merge")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """An existing relational store as a source, read in parallel key ranges."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower),
                 upperBound=str(upper), numPartitions=str(partitions), **options)
        .load()
    )


def write_text(df: DataFrame, text_col: str, path: str) -> None:
    """One line block per row as text files."""
    df.select(text_col).write.mode("errorifexists").text(path)
