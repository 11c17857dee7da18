"""Combining many partial results of tasks into one per key, a few at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCHEMA = "key BIGINT, payload BINARY"


def folded(parts: DataFrame, combine: Callable[[list[bytes]], bytes], fan_in: int = 16) -> DataFrame:
    """(key, payload), one row per key of ``parts`` (key, payload), stored.

    Rounds of groups of about ``fan_in`` payloads, so no task and not the driver ever holds all of a key. Within a group
    payloads are combined in the order of their stored numbers.
    """
    rows = stored(parts.select("key", "payload", F.monotonically_increasing_id().alias("nr")), "parts")
    most = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def group(key, table):
        table = table.sort_by("nr")
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "payload": pa.array([combine(table.column("payload").to_pylist())], pa.binary()),
                         "nr": pa.array([key[1].as_py()], pa.int64())})

    while most > 1:
        most = -(-most // fan_in)
        # Numbers of a key are spread evenly; a slot's number is that of the next round's payload.
        slotted = rows.withColumn("slot", F.pmod(F.xxhash64("nr"), F.lit(most)) if most > 1 else F.lit(0).cast("long"))
        rows = stored(slotted.groupBy("key", "slot").applyInArrow(group, "key BIGINT, payload BINARY, nr BIGINT"), "parts")
    return rows.select("key", "payload")
