"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A key that is repeated in a JSON object has its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}
#: Settings that hold where the session leaves them open. Rows of keys and numbers shrink to a tenth in a shuffle, so 64 MB of
#: them, Spark's own size of a task's share, are a gigabyte in its hash tables and sorts. Texts on their way to Python and back
#: lie in both processes of every task; the most bytes of a batch, 64 MB by Spark's own, bound them where texts are long.
OPEN_SETTINGS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}
STATIC_SETTINGS = {
    # Recording the Python line of every column expression costs more than planning the query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def new_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with all settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("matchflow")
    if master:
        builder = builder.master(master)
    named = {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in {**SETTINGS, **OPEN_SETTINGS, **STATIC_SETTINGS, **named}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    given = spark.conf.getAll
    for key, value in OPEN_SETTINGS.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="matchflow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current
