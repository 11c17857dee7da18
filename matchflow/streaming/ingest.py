"""Continuous ingest: fingerprint, drop what is stored, insert the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import append_unique
from ..operators.text import fingerprint


def ingest_stream(arrivals: DataFrame, store_path: str, checkpoint: str, text: str, order: list[str],
                  ts: str | None = None, lateness: str = "1 day", base: DataFrame | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Append texts with a new fingerprint to ``store_path``, one folder per micro-batch.

    With an event time ``ts``, copies that arrive within ``lateness`` are dropped in the state
    store; older copies are caught against the stored rows. A micro-batch that is run again
    after a failure reads only earlier folders and overwrites its own, so it inserts the same
    rows once. ``base`` is an existing store the stream only reads.
    """
    marked = arrivals.withColumn("fingerprint", fingerprint(text))
    if ts is not None:
        marked = marked.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["fingerprint"])

    def insert(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = session.createDataFrame([], "fingerprint string")
        if base is not None:
            known = known.unionByName(base.select("fingerprint"))
        stored = stored_rows(session, store_path)
        if stored is not None:
            known = known.unionByName(stored.filter(F.col("batch") < batch_id).select("fingerprint"))
        new, _ = append_unique(batch, known, "fingerprint", order)
        new.write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")

    writer = marked.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stored_rows(spark: SparkSession, store_path: str) -> DataFrame | None:
    """Rows of the finished micro-batches with their ``batch`` number, None before the first."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{store_path}/batch=*/_SUCCESS")
    files = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.globStatus(pattern):
        return None
    return spark.read.option("basePath", store_path).parquet(f"{store_path}/batch=*")
