"""Sharding along a Hilbert curve, with DataFrame functions only.

Language, source, size and id are quantised to a few bits each; rows are ordered by the index of their cell on a
Hilbert curve through the four dimensions, and the order is cut into runs of equal row counts. Neighbours on the
curve are neighbours in every dimension, so each run spans a small box and filters on any dimension skip files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS = 4
DIMS = ("d_lang", "d_source", "d_size", "d_id")
#: Rows that are ordered together at most, roughly; cells with more are split by a hash first.
ORDERED_TOGETHER = 4096


def hilbert_index(cell: list, bits: int = BITS):
    """Index on the Hilbert curve of integer coordinates below 2**bits (columns).

    From the top bit down and for each coordinate in turn: where it has the bit, the first coordinate's lower bits are
    flipped, else those of the two are exchanged. What is left is a Gray code over coordinates and bits.
    """
    n, tops = len(cell), [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in tops for i in range(n)])

    def turned(x, s):
        q, i = s["q"], s["i"]
        low, there = q - F.lit(1), F.get(x, i)
        exchange = F.get(x, F.lit(0)).bitwiseXOR(there).bitwiseAND(low)
        return F.transform(x, lambda v, k: F.when(there.bitwiseAND(q) != 0, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
                           .otherwise(F.when((k == 0) | (k == i), v.bitwiseXOR(F.when(i == 0, F.lit(0)).otherwise(exchange))).otherwise(v)))

    x = F.aggregate(steps, F.array(*[c.cast("int") for c in cell]), turned)
    gray = F.transform(x, lambda v, k: F.aggregate(F.slice(x, F.lit(1), k + 1), F.lit(0), lambda a, w: a.bitwiseXOR(w)))
    turn = F.aggregate(F.array(*[F.lit(q) for q in tops]), F.lit(0), lambda t, q: F.when(
        F.get(gray, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - F.lit(1))).otherwise(t))
    final = F.transform(gray, lambda v: v.bitwiseXOR(turn))
    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)]), F.lit(0), lambda h, q: F.aggregate(
        final, h, lambda g, v: g * 2 + F.when(v.bitwiseAND(q) != 0, F.lit(1)).otherwise(F.lit(0))))


def quantile_code(value, cuts: list):
    """How many of the cuts lie below a value (null: 0)."""
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value)), F.lit(0)) if cuts else F.lit(0)


def name_code(value):
    """A name's code: four bits of its hash (null: 0), so that each name lies in one slice."""
    return F.when(value.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(value), F.lit(1 << BITS)).cast("int"))


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, lang, source): UTF-8 bytes plus one (null text: 1) and the checksum (null: 0)."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))


def curve_order(docs: DataFrame, **columns: str) -> tuple[DataFrame, int]:
    """(id, size, text_crc32, lang, source, cell, place long) and the row count: every row's exact place along the curve.

    Places come from sums over cells (at most 2**16, a fixed number), over the hash slices of a cell, and from an
    order within a slice of bounded size; no task ever holds all rows, nor all of a cell.
    """
    rows = stored(metadata(docs, **columns).withColumn("nr", F.monotonically_increasing_id()), "metadata")
    shares = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    n, cuts_size, cuts_id = rows.agg(
        F.count(F.lit(1)), F.percentile_approx("size", shares, 1000), F.percentile_approx(F.col("id").cast("long"), shares, 1000)).first()
    slices = max(1, -(-n // ORDERED_TOGETHER))
    coded = rows.select(
        "*", name_code(F.col("lang")).alias("d_lang"), name_code(F.col("source")).alias("d_source"),
        quantile_code(F.col("size"), cuts_size or []).alias("d_size"), quantile_code(F.col("id").cast("long"), cuts_id or []).alias("d_id"),
        F.pmod(F.xxhash64("nr"), F.lit(slices)).cast("int").alias("slice"))
    coded = coded.withColumn("cell_key", F.expr(" + ".join(f"{d} * {1 << (BITS * k)}" for k, d in enumerate(DIMS))).cast("int"))

    counts = stored(coded.groupBy("cell_key", "slice", *DIMS).agg(F.count(F.lit(1)).alias("n")), "cells")
    cells = counts.groupBy("cell_key", *DIMS).agg(F.sum("n").alias("n")).select(
        "cell_key", "n", hilbert_index([F.col(d) for d in DIMS]).alias("cell"))
    before_cell = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("cell_key", "cell", F.coalesce(before_cell, F.lit(0)).alias("cell_start"))
    before_slice = F.sum("n").over(Window.partitionBy("cell_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("cell_key", "slice", F.coalesce(before_slice, F.lit(0)).alias("slice_start")).join(F.broadcast(cells), "cell_key")
    starts = starts.select("cell_key", "slice", "cell", (F.col("cell_start") + F.col("slice_start")).alias("start"))
    within = F.row_number().over(Window.partitionBy("cell_key", "slice").orderBy("id", "size", "text_crc32", "nr"))
    ordered = coded.withColumn("within", within).join(starts, ["cell_key", "slice"])
    return ordered.select("id", "size", "text_crc32", "lang", "source", "cell", (F.col("start") + F.col("within") - 1).alias("place")), n


def shards(docs: DataFrame, count: int = 8, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """(doc_id, size, text_crc32, lang, source, cell, law, shard, slot, grown_shard): runs of the curve with equal row counts.

    * law ``rows``: counts differ by one at most; ``grown_shard`` is null, as one more shard would move every cut
    * null text: size 1, checksum 0; null lang, source or id: the first slice of that dimension
    * ties and repeated rows: each has a slot of its own; empty table: no rows; other columns are not looked at
    * a cell with any share of the rows is ordered in hash slices of about 4,096 rows
    """
    ordered, n = curve_order(docs, id_col=id_col, **columns)
    least, more = divmod(n, count)
    place = F.col("place")
    if least:
        shard = F.when(place < more * (least + 1), F.floor(place / (least + 1))).otherwise(more + F.floor((place - more * (least + 1)) / least))
    else:
        shard = place
    shard = shard.cast("int")
    start = F.col("shard") * least + F.least(F.col("shard"), F.lit(more))
    return ordered.withColumn("shard", shard).select(
        F.col("id").alias(id_col), "size", "text_crc32", "lang", "source", "cell", F.lit("rows").alias("law"), "shard",
        (place - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Write shards as folders, rows in slot order within a file, and return what a reader needs to skip them.

    (shard, n, and least and greatest of lang, source, size and id); equal shards are spread over tasks by slot range.
    """
    width = 100_000
    sharded.repartition("shard", F.floor(F.col("slot") / width)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return shard_bounds(sharded)


def shard_bounds(sharded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), *[f(F.col(c)).alias(f"{name}_{c}") for c in ("lang", "source", "size", id_col)
                                        for name, f in (("min", F.min), ("max", F.max))])
