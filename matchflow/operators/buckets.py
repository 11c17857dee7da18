"""Stored tables in hash buckets of their key: a batch of changes reads and writes only the buckets it touches.

The changes themselves are the functions of ``store``: ``upsert``, ``patch``, ``vector_put`` and so on see the touched
buckets in place of the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Change = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Buckets:
    """A table at ``path``, one folder per bucket; ``keys`` (unique together, nulls allowed) decide the bucket.

    Changes of one table must follow each other. A change first writes the new content of its buckets beside the table
    and then puts it in place; after a failure ``recover``, which every access calls, finishes or drops it, so that
    the table is always that before or that after a batch, and a batch that runs again gives the same rows.
    """

    path: str
    keys: tuple[str, ...]
    count: int = 256

    @property
    def column(self) -> str:
        return f"bucket_of_{self.count}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int").alias(self.column)

    def _files(self, spark: SparkSession, path: str):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place

    def _exists(self, spark: SparkSession, path: str) -> bool:
        files, place = self._files(spark, path)
        return files.exists(place)

    def _remove(self, spark: SparkSession, path: str) -> None:
        files, place = self._files(spark, path)
        files.delete(place, True)

    def create(self, rows: DataFrame, files: int = 1) -> None:
        """Write a new table, ``files`` files a bucket; a folder that exists is never replaced."""
        numbered = rows.withColumn(self.column, self._bucket())
        spread = numbered.repartition(self.column, F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(files)))
        spread.write.mode("errorifexists").partitionBy(self.column).parquet(self.path)

    def read(self, spark: SparkSession, numbers: Sequence[int] | None = None) -> DataFrame:
        """The table, or the given buckets of it; others are not even listed as files of the scan."""
        self.recover(spark)
        rows = spark.read.parquet(self.path)
        return (rows if numbers is None else rows.where(F.col(self.column).isin(list(numbers)))).drop(self.column)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets with a key of the batch; at most ``count`` numbers come to the driver."""
        return sorted(r[0] for r in batch.select(self._bucket()).distinct().collect())

    def change(self, batch: DataFrame, how: Change) -> list[int]:
        """Replace the touched buckets by ``how(their rows, batch)``; returns their numbers. No row may change its key."""
        spark = batch.sparkSession
        kinds = {f.name: f.dataType for f in self.read(spark).schema.fields}
        batch = batch.withColumns({k: F.col(k).cast(kinds[k]) for k in self.keys})
        numbers = self.touched(batch)
        if not numbers:
            return numbers
        rows = how(self.read(spark, numbers), batch).withColumn(self.column, self._bucket())
        rows.repartition(self.column).write.mode("overwrite").parquet(self.path + ".pending/rows")
        # Once this is there the change counts.
        spark.createDataFrame([(n,) for n in numbers], f"{self.column} INT").coalesce(1).write.mode("overwrite").parquet(self.path + ".pending/buckets")
        self.recover(spark)
        return numbers

    def recover(self, spark: SparkSession) -> None:
        """Finish a change that was complete but not in place; drop one that was not complete."""
        pending = self.path + ".pending"
        if not self._exists(spark, pending):
            return
        if self._exists(spark, pending + "/buckets/_SUCCESS"):
            rows = spark.read.parquet(pending + "/rows")
            numbers = {r[0] for r in spark.read.parquet(pending + "/buckets").collect()}
            left = {r[0] for r in rows.select(self.column).distinct().collect()}
            rows.repartition(self.column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.column).parquet(self.path)
            for n in numbers - left:  # buckets that have lost all their rows
                self._remove(spark, f"{self.path}/{self.column}={n}")
        self._remove(spark, pending)
