"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` has made, once all that was made of them is stored itself.

    The driver's garbage collection then lets Spark clear the shuffles of jobs that nothing refers to any more.
    """
    for table in tables:
        sc = table.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        sc._jvm.System.gc()


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name`` that is different for every row and the same however often the rows are read.

    Rows of files are told apart by file and position; others are numbered and stored first.
    """
    try:
        out = docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
        out.schema  # is analysed here
        return out
    except AnalysisException:
        return stored(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "numbered")


def process_memo(name: str) -> dict:
    """A dictionary for things costly to build per task, kept by the Python worker until it asks for one of another name."""
    holder = sys.modules.setdefault("matchflow_process_memo", types.ModuleType("matchflow_process_memo"))
    if getattr(holder, "name", None) != name:
        # A worker outlives its stage; what the operators before it have remembered must not pile up.
        holder.name, holder.memo = name, {}
        trim_memory()
    return holder.memo


def trim_memory() -> None:
    """Give memory that this process has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text), so that no other column of the input can clash; a null text is empty."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


#: Bits of a bitmap that goes to every task (2 MB), and of one of its rows.
BITMAP_BITS, BITMAP_ROW = 1 << 24, 1 << 15


def with_hint(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false where ``key`` is not among the wanted keys, nulls included; true may be a mistake.

    The wanted keys lie in a bitmap of their digests, of the same size however many they are. So rows that can't be wanted
    are told apart without a shuffle.
    """
    tag = "_" * max(map(len, rows.columns))  # longer than any name of the rows
    slot, row, bits = "slot" + tag, "row" + tag, "bits" + tag
    slot_of = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS))
    row_of = F.floor(F.col(slot) / BITMAP_ROW).alias(row)
    bitmaps = wanted.select(slot_of(wanted_key).alias(slot)).groupBy(row_of).agg(F.bitmap_construct_agg(F.col(slot) % BITMAP_ROW).alias(bits))
    byte = F.substring(F.col(bits), F.floor(F.col(slot) % BITMAP_ROW / 8).cast("int") + 1, F.lit(1))
    marked = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr(f"shiftleft(1, CAST({slot} % 8 AS INT))")) != 0
    met = rows.withColumn(slot, slot_of(key)).select("*", row_of).join(F.broadcast(bitmaps), row, "left")
    return met.withColumn(name, F.coalesce(marked, F.lit(False))).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def perhaps_among(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among the wanted keys; an exact join has to follow."""
    return with_hint(rows, key, wanted, wanted_key, "_perhaps").where("_perhaps").drop("_perhaps")


def arrow_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=schema.field(k).type) for k, v in columns.items()],
        schema=schema)
