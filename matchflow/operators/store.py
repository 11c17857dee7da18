"""Table maintenance: newest rows, look-ups, unique inserts, upserts, patches, deletes, checks.

Nothing here changes a table in place: every function returns the new content as a DataFrame,
to be written to a new snapshot folder (``sources.tables.write_snapshot``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import settle

INSERTED, DUP_IN_BATCH, DUP_IN_STORE = "inserted", "dup_in_batch", "dup_in_store"


def recent(df: DataFrame, ts: str, key: str, n: int = 100,
           columns: Sequence[str] | None = None) -> DataFrame:
    """Newest ``n`` rows. A top-n per task and one merge, never a full sort."""
    kept = df.select(*columns) if columns else df
    return kept.orderBy(F.desc(ts), F.asc(key)).limit(n)


def lookup(df: DataFrame, keys: DataFrame, on: str | list[str], exists: bool = False) -> DataFrame:
    """Rows of ``df`` for a set of keys; ``exists`` keeps only the columns of ``keys`` that hit.

    Keys are made distinct first, so a repeated key never multiplies rows. No broadcast is
    forced: the size of the key side decides at run time.
    """
    names = [on] if isinstance(on, str) else list(on)
    wanted = keys.select(*names).distinct()
    if exists:
        return wanted.join(df.select(*names), names, "left_semi")
    return df.join(wanted, names, "left_semi")


# --- insert if new ---------------------------------------------------------------------------


def first_arrivals(batch: DataFrame, hash_col: str, order: Sequence[str]) -> DataFrame:
    """One narrow row per fingerprint: the first row's ``order`` columns and the group size.

    The minimum combines on the map side, so a fingerprint holding a third of the batch costs
    one row per task in the shuffle. The last ``order`` column must identify the row; alone, it
    is a plain minimum, which aggregates by hash instead of by sort.
    """
    if len(order) == 1:
        small = batch.groupBy(hash_col).agg(F.min(order[0]).alias("_id"), F.count(F.lit(1)).alias("n"))
        return small.select(hash_col, F.struct(F.col("_id").alias(order[0])).alias("first"), "n")
    return batch.groupBy(hash_col).agg(
        F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n")
    )


def append_unique(batch: DataFrame, store: DataFrame, hash_col: str,
                  order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, report). A row is inserted when its fingerprint is not in ``store`` and
    no earlier row of the batch has it; the report counts the three outcomes.

    The payload is joined on the unique row id, not on the fingerprint, so copies of one text
    cannot pile up in one task.
    """
    row_id = order[-1]
    firsts = first_arrivals(batch, hash_col, order)
    stored = store.select(hash_col).distinct().withColumn("in_store", F.lit(True))
    marked = firsts.join(stored, hash_col, "left")
    new = marked.filter("in_store is null").select(F.col(f"first.{row_id}").alias(row_id))
    inserted = batch.join(new, row_id, "left_semi")
    sums = marked.agg(
        F.coalesce(F.count_if(F.col("in_store").isNull()), F.lit(0)).alias(INSERTED),
        F.coalesce(F.sum(F.when(F.col("in_store").isNull(), F.col("n") - 1)), F.lit(0)).alias(DUP_IN_BATCH),
        F.coalesce(F.sum(F.when(F.col("in_store"), F.col("n"))), F.lit(0)).alias(DUP_IN_STORE),
    )
    report = sums.select(
        F.explode(F.create_map(*[x for c in (INSERTED, DUP_IN_BATCH, DUP_IN_STORE)
                                 for x in (F.lit(c), F.col(c))])).alias("outcome", "rows")
    )
    return inserted, report


# --- insert or replace --------------------------------------------------------------------------


def latest_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key, combined on the map side."""
    rest = [c for c in batch.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    best = batch.groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*").select(*batch.columns)


def one_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str] | None) -> DataFrame:
    """One row per key: the last by ``order``; without an order the greatest, column by column in alphabetical order.

    So a batch that is read again after a lost task, in whatever order, gives the same rows. Nulls are smallest; maps,
    which have no order, are compared by their JSON.
    """
    if order:
        return latest_per_key(batch, keys, order)
    rest = sorted(c for c in batch.columns if c not in keys)
    if not rest:
        return batch.distinct()
    ordered = [F.to_json(F.struct(c)) if "map<" in batch.schema[c].dataType.simpleString() else F.col(c) for c in rest]
    best = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*ordered)).alias("_row"))
    return best.select(*keys, "_row.*").select(*batch.columns)


def upsert(batch: DataFrame, store: DataFrame, keys: Sequence[str], now: Column | None = None,
           id_col: str | None = None, digest: str | None = None,
           stamp: str | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Store content after inserting or replacing the rows of ``batch``.

    Of several rows of ``batch`` with one key the last by ``order`` counts; without an order, the
    greatest by all its columns.

    A replaced row takes every non-key column of the new row, keeps ``id_col`` and gets ``now``
    in ``stamp``. With ``digest``, a row whose stored digest is equal stays as it was. The choice
    is made per row, so a null in the new row does replace a stored value.
    """
    batch = one_per_key(batch, keys, order)
    old = store.withColumn("_old", F.lit(True)).alias("o")
    new = batch.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    take = F.col("_new").isNotNull()
    if digest is not None:
        same = F.col(f"o.{digest}") == F.col(f"n.{digest}")
        take = take & (F.col("_old").isNull() | ~F.coalesce(same, F.lit(False)))
    out = []
    for name in store.columns:
        kept, fresh = F.col(f"o.{name}"), (F.col(f"n.{name}") if name in batch.columns else F.lit(None))
        if name == id_col:
            out.append(F.coalesce(kept, fresh).alias(name))
        elif name == stamp and now is not None:
            out.append(F.when(take, now).otherwise(kept).alias(name))
        elif name not in batch.columns and name not in keys:
            out.append(kept.alias(name))
        else:
            out.append(F.when(take, fresh).otherwise(kept).alias(name))
    return joined.select(*out)


def upsert_if_changed(batch: DataFrame, store: DataFrame, keys: Sequence[str], digest: str,
                      now: Column | None = None, id_col: str | None = None,
                      stamp: str | None = None, order: Sequence[str] | None = None) -> DataFrame:
    return upsert(batch, store, keys, now, id_col, digest, stamp, order)


def assign_ids(df: DataFrame, start: Column | int, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """Consecutive ids after ``start`` in ``order``.

    Rows are range-partitioned by ``order`` and settled once; each partition is then numbered
    on its own and shifted by the sizes of the partitions before it (one number per partition on
    the driver). No window over the whole table.
    """
    spread = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in spread.groupBy("_part").count().collect()}
    shift, total = {}, 0
    for part in sorted(sizes):
        shift[part] = total
        total += sizes[part]
    if not shift:
        return spread.drop("_part").withColumn(id_col, F.lit(None).cast("bigint"))
    offsets = F.create_map(*[F.lit(x) for pair in shift.items() for x in pair])
    number = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    base = F.lit(start) if isinstance(start, int) else start
    return spread.withColumn(id_col, (base + offsets[F.col("_part")] + number).cast("bigint")).drop("_part")


# --- patch, vectors -----------------------------------------------------------------------------


def patch(store: DataFrame, edits: DataFrame, key: str, columns: Sequence[str],
          now: Column | None = None, stamp: str = "updated_at", clear: str | None = None,
          overwrite: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """Per-column update by key: a null in an edit keeps the stored value.

    Of several edits of one key the last by ``order`` counts, whole; without an order, the
    greatest by all its columns.

    ``clear`` names an edit column listing the columns to set to null; ``overwrite`` takes every
    edit value as it is. Rows without an edit are unchanged; edited rows get ``now``.
    """
    extra = [clear] if clear else []
    changes = one_per_key(edits, [key], order).select(key, *columns, *extra).withColumn("_edit", F.lit(True)).alias("e")
    joined = store.alias("s").join(changes, F.col(f"s.{key}") == F.col(f"e.{key}"), "left")
    hit = F.col("_edit").isNotNull()
    out = []
    for name in store.columns:
        value = F.col(f"s.{name}")
        if name in columns:
            new = F.col(f"e.{name}")
            value = F.when(hit, new).otherwise(value) if overwrite else F.coalesce(new, value)
            if clear:
                cleared = F.coalesce(F.array_contains(F.col(f"e.{clear}"), name), F.lit(False))
                value = F.when(~cleared, value)
        elif name == stamp and now is not None:
            value = F.when(hit, now).otherwise(value)
        out.append(value.alias(name))
    return joined.select(*out)


def vector_put(store: DataFrame, vectors: DataFrame, key: str, column: str,
               order: Sequence[str] | None = None) -> DataFrame:
    """Set the vector column for a set of keys; repeated keys as in ``patch``."""
    return patch(store, vectors, key, [column], overwrite=True, order=order)


# --- delete ----------------------------------------------------------------------------------------


def delete_cascade(keys: DataFrame, key: str, parent: DataFrame,
                   children: Mapping[str, tuple[DataFrame, str]],
                   ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete parents and every child row that refers to them.

    ``children`` maps a table name to (table, column holding the parent key). Returns the tables
    that remain (the parent under "parent") and one row per table with the number deleted.
    """
    gone = keys.select(key).distinct()
    tables = {"parent": (parent, key), **children}
    left, counts = {}, []
    for name, (table, fk) in tables.items():
        doomed = gone.select(F.col(key).alias(fk))
        left[name] = table.join(doomed, fk, "left_anti")
        counts.append(
            table.select(fk).join(doomed, fk, "left_semi")
            .agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        )
    report = counts[0]
    for part in counts[1:]:
        report = report.unionByName(part)
    return left, report


# --- checks and statistics ----------------------------------------------------------------------------


@dataclass(frozen=True)
class TableRules:
    """Constraints of one table; every rule names its columns."""

    unique: Sequence[Sequence[str]] = ()
    not_null: Sequence[str] = ()
    foreign: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, key)
    max_length: Mapping[str, int] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)


def constraint_report(tables: Mapping[str, DataFrame], rules: Mapping[str, TableRules]) -> DataFrame:
    """Violations as (table_name, rule, column_name, value, rows): one row per broken value.

    Row rules of a table (null, length, range) share one scan. Counts combine on the map side,
    so a value that breaks a rule millions of times still travels as one row per task.
    """
    parts: list[DataFrame] = []

    def report(df: DataFrame, table: str, rule: Column | str, column: Column | str) -> DataFrame:
        return df.select(
            F.lit(table).alias("table_name"),
            (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
            (F.lit(column) if isinstance(column, str) else column).alias("column_name"),
            "value",
            F.col("rows").cast("bigint").alias("rows"),
        )

    for name, rule in rules.items():
        df = tables[name]
        for cols in rule.unique:
            value = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
            doubled = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
            parts.append(report(doubled.withColumn("value", value), name, "unique", "|".join(cols)))
        checks = [(F.col(c).isNull(), "not_null", c, F.lit(None)) for c in rule.not_null]
        checks += [(F.length(c) > n, "max_length", c, F.length(c)) for c, n in rule.max_length.items()]
        checks += [
            ((F.col(c) < lo) | (F.col(c) > hi), "range", c, F.col(c)) for c, (lo, hi) in rule.ranges.items()
        ]
        if checks:
            broken = F.array_compact(F.array(*[
                F.when(bad, F.struct(F.lit(kind).alias("rule"), F.lit(c).alias("column"),
                                     value.cast("string").alias("value")))
                for bad, kind, c, value in checks
            ]))
            rows = df.select(F.inline(broken)).groupBy("rule", "column", "value").agg(
                F.count(F.lit(1)).alias("rows"))
            parts.append(report(rows, name, F.col("rule"), F.col("column")))
        for column, (parent, key) in rule.foreign.items():
            refs = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
            known = tables[parent].select(F.col(key).alias(column))
            lost = refs.join(known, column, "left_anti").withColumn("value", F.col(column).cast("string"))
            parts.append(report(lost, name, "foreign", column))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, rows, nulls, null_rate): one aggregate per table, no rows moved."""
    parts = []
    for name, df in tables.items():
        sums = df.agg(F.count(F.lit(1)).alias("_rows"),
                      *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])
        parts.append(sums.select(F.lit(name).alias("table_name"), F.col("_rows").alias("rows"), F.inline(cells)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    rate = F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(F.lit(0.0))
    return out.select("table_name", "column_name", "rows", "nulls", rate.alias("null_rate"))
