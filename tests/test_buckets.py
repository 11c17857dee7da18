import os

import pytest
from pyspark.sql import functions as F

from matchflow.operators import store
from matchflow.operators.buckets import Buckets

SCHEMA = "k BIGINT, part STRING, v STRING, n INT"


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    made = Buckets(str(tmp_path / "t"), ("k", "part"), 32)
    rows = [(k, "a" if k % 2 else None, f"v{k}", k) for k in range(1000)] + [(None, None, "no key", 0)]
    made.create(spark.createDataFrame(rows, SCHEMA).repartition(4))
    return made


def upsert(rows, batch):
    return store.upsert(batch, rows, ["k", "part"])


def test_a_batch_touches_only_its_buckets(spark, table):
    before = files_of(table.path)
    batch = spark.createDataFrame([(4, None, "new", 1), (5, "a", "new", 1), (5000, "b", "new", 1), (None, None, "new", 1)], SCHEMA)
    numbers = table.change(batch, upsert)
    assert 1 <= len(numbers) <= 4
    after = files_of(table.path)
    inside = lambda f: any(f"{table.column}={n}/" in f for n in numbers)
    assert {f: t for f, t in before.items() if not inside(f)} == {f: t for f, t in after.items() if not inside(f)}
    assert all(inside(f) for f in after.keys() - before.keys())
    # What is read for the change: the scan has the touched buckets' files only.
    read = table.read(spark, numbers)
    assert read.inputFiles() and "PartitionFilters: [bucket_of_32" in read._jdf.queryExecution().executedPlan().toString()
    got = {(r["k"], r["part"]): r["v"] for r in table.read(spark).collect()}
    assert len(got) == 1002 and [k for k, v in got.items() if v == "new"].__len__() == 4


def test_the_same_batch_again(spark, table):
    batch = spark.createDataFrame([(k, "a", "x", -1) for k in range(1, 2000, 7)], SCHEMA)
    table.change(batch, upsert)
    once = sorted(map(str, table.read(spark).collect()))
    table.change(batch, upsert)
    assert sorted(map(str, table.read(spark).collect())) == once


def test_failures_leave_the_table_before_or_after(spark, table, monkeypatch):
    batch = spark.createDataFrame([(1, "a", "changed", 1)], SCHEMA)
    value = lambda: {r["v"] for r in table.read(spark).where("k = 1").collect()}

    def fails(rows, batch):
        return upsert(rows, batch).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        table.change(batch, fails)
    assert value() == {"v1"} and not os.path.exists(table.path + ".pending")
    # Complete, but not put in place: the next access does that.
    monkeypatch.setattr(Buckets, "recover", lambda self, spark: None)
    table.change(batch, upsert)
    assert os.path.exists(table.path + ".pending/buckets/_SUCCESS")
    monkeypatch.undo()
    assert value() == {"changed"} and not os.path.exists(table.path + ".pending")


def test_other_changes_and_emptied_buckets(spark, table):
    edits = spark.createDataFrame([(k, None, 77) for k in range(0, 100, 2)], "k BIGINT, part STRING, n INT")
    one = Buckets(table.path, ("k", "part"), 32)
    one.change(edits, lambda rows, batch: rows.join(batch, [rows.k.eqNullSafe(batch.k), rows.part.eqNullSafe(batch.part)], "left").select(
        rows.k, rows.part, rows.v, F.coalesce(batch.n, rows.n).alias("n")))
    assert table.read(spark).where("n = 77").count() == 51  # and the row that had it
    gone = table.read(spark).select("k", "part")
    table.change(gone, lambda rows, batch: rows.where("false"))
    assert not [d for d in os.listdir(table.path) if d.startswith("bucket")]


def test_key_types_of_the_table_decide(spark, table):
    batch = spark.createDataFrame([(3, "a", "int key", 1)], "k INT, part STRING, v STRING, n INT")
    table.change(batch, upsert)
    assert [r["v"] for r in table.read(spark).where("k = 3").collect()] == ["int key"]
    assert table.change(batch.limit(0), upsert) == []
