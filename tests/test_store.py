import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchflow import schemas
from matchflow.operators import export, store
from matchflow.operators.text import fingerprint
from matchflow.sources import files, tables

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_recent_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(3, T0), (1, T1), (2, T1)], "id long, ts timestamp")
    assert [r.id for r in store.recent(df, "ts", "id", 2).collect()] == [1, 2]


def test_lookup_ignores_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    keys = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    assert rows(store.lookup(df, keys, "id"), "id", "v") == [(1, "a")]
    assert rows(store.lookup(df, keys, "id", exists=True), "id") == [(1,)]


def test_append_unique_is_idempotent_and_survives_a_hot_fingerprint(spark):
    batch = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    batch = batch.withColumn("h", fingerprint("text"))
    empty = batch.limit(0)
    new, report = store.append_unique(batch, empty, "h", ["id"])
    assert dict(rows(report, "outcome", "rows")) == {"inserted": 2001, "dup_in_batch": 999, "dup_in_store": 0}
    assert new.filter("text = 'same'").collect()[0].id == 0
    again, report = store.append_unique(batch, new, "h", ["id"])
    assert again.count() == 0
    assert dict(rows(report, "outcome", "rows"))["dup_in_store"] == 3000


def test_upsert_replaces_rows_and_keeps_ids(spark):
    old = spark.createDataFrame([(1, "a", "x", T0), (2, "b", "y", T0)], "id long, k string, v string, at timestamp")
    new = spark.createDataFrame([(9, "a", None, T0), (9, "c", "z", T0)], "id long, k string, v string, at timestamp")
    out = store.upsert(new, old, ["k"], F.lit(T1), "id", stamp="at")
    assert rows(out, "k", "id", "v", "at") == [("a", 1, None, T1), ("b", 2, "y", T0), ("c", 9, "z", T1)]


def test_upsert_if_changed_leaves_equal_digests_alone(spark):
    old = spark.createDataFrame([("a", "d1", 1), ("b", "d2", 1)], "k string, d string, v int")
    new = spark.createDataFrame([("a", "d1", 2), ("b", "d9", 2)], "k string, d string, v int")
    assert rows(store.upsert_if_changed(new, old, ["k"], "d"), "k", "v") == [("a", 1), ("b", 2)]


def test_latest_per_key_takes_the_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert rows(store.latest_per_key(df, ["k"], ["n"]), "k", "v") == [("a", "y"), ("b", "z")]


def test_assign_ids_are_consecutive(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.lpad("id", 4, "0")).alias("k"))
    out = store.assign_ids(df, 100, ["k"]).orderBy("k").collect()
    assert [r.id for r in out] == list(range(101, 601))


def test_patch_keeps_on_null_and_can_clear(spark):
    base = spark.createDataFrame([(1, "s", ["p"]), (2, "t", ["q"])], "id long, summary string, projects array<string>").withColumn("updated_at", F.lit(T0))
    edits = spark.createDataFrame([(1, None, ["n"], ["summary"])], "id long, summary string, projects array<string>, gone array<string>")
    kept = store.patch(base, edits, "id", ["summary", "projects"], F.lit(T1))
    assert rows(kept, "id", "summary", "projects", "updated_at") == [(1, "s", ["n"], T1), (2, "t", ["q"], T0)]
    cleared = store.patch(base, edits, "id", ["summary", "projects"], clear="gone")
    assert rows(cleared, "id", "summary") == [(1, None), (2, "t")]


def test_delete_cascade_leaves_no_orphans(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "c long, pid long")
    left, report = store.delete_cascade(spark.createDataFrame([(1,)], "id long"), "id", parent, {"child": (child, "pid")})
    assert rows(left["child"], "c") == [(12,)]
    assert rows(report, "table", "deleted") == [("child", 2), ("parent", 1)]
    rules = {"child": store.TableRules(foreign={"pid": ("parent", "id")})}
    assert store.constraint_report(left, rules).count() == 0


def test_constraint_report_names_every_rule(spark):
    t = spark.createDataFrame([(1, None, "long text", 5.0), (1, "x", "ok", -1.0)], "id long, n string, s string, v double")
    rules = {"t": store.TableRules(unique=[["id"]], not_null=["n"], max_length={"s": 4}, ranges={"v": (0, 3)})}
    out = rows(store.constraint_report({"t": t}, rules), "rule", "value", "rows")
    assert sorted(out, key=str) == sorted([("unique", "1", 2), ("not_null", None, 1), ("max_length", "9", 1),
                                           ("range", "5.0", 1), ("range", "-1.0", 1)], key=str)


def test_constraint_query_reports_every_broken_rule_and_lost_parents(spark, tmp_path):
    """The registered query against its own SQL on rows that break each rule once."""
    import duckdb

    import __spark_entry__ as entry

    made = {
        "customer": ([(1,), (2,)], "c_custkey long"),
        "orders": ([(10, 1, T0, "LOW"), (10, 2, T0, "LOW"), (11, 7, T0, "LOW"), (12, None, T0, "LOW"), (13, 1, None, "LOW"), (14, 2, T1, "much too long")],
                   "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(10, 1, 0.01), (99, 1, 0.02), (99, 2, 0.02), (None, 1, 0.03), (11, 1, -0.25), (12, 1, 0.5)],
                     "l_orderkey long, l_linenumber int, l_discount double"),
        "labels": ([(1,), (5,)], "doc_id long"),
        "embeddings": ([(1,)], "vec_id long"),
    }
    con = duckdb.connect()
    for name, (data, layout) in made.items():
        spark.createDataFrame(data, layout).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in entry.queries()["constraint_report"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([
        ("orders", "unique", "o_orderkey", "10", 2), ("orders", "not_null", "o_custkey", None, 1), ("orders", "not_null", "o_orderdate", None, 1),
        ("orders", "foreign", "o_custkey", "7", 1), ("orders", "max_length", "o_orderpriority", "13", 1), ("lineitem", "foreign", "l_orderkey", "99", 2),
        ("lineitem", "range", "l_discount", "-0.25", 1), ("lineitem", "range", "l_discount", "0.5", 1), ("labels", "foreign", "doc_id", "5", 1)], key=str)
    assert sorted(got, key=str) == sorted(con.execute(entry.oracle_sql()["constraint_report"]).fetchall(), key=str)


def test_table_stats_of_an_empty_table(spark):
    out = store.table_stats({"t": spark.createDataFrame([], "a int")}).first()
    assert (out["rows"], out["nulls"], out["null_rate"]) == (0, 0, 0.0)


def test_scan_files_gate_and_dedupe(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.DOCX").write_bytes(b"two")
    (tmp_path / "c.txt").write_bytes(b"three")
    (tmp_path / "d.pdf").write_bytes(b"x" * 200)
    inventory = files.scan_files(spark, str(tmp_path), max_bytes=100)
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in inventory.collect()}
    assert reasons == {"a.pdf": None, "b.DOCX": None, "c.txt": "unsupported type", "d.pdf": "file too large"}
    stored = inventory.filter("path like '%a.pdf'").select("file_hash")
    accepted, rejected = files.split_files(inventory, stored)
    assert [r.path.rsplit("/", 1)[1] for r in accepted.collect()] == ["b.DOCX"]
    assert rejected.filter("reason = 'already stored'").count() == 1


def test_snapshot_never_replaces_a_folder(spark, tmp_path):
    path = str(tmp_path / "s")
    assert tables.write_snapshot(spark.range(3).toDF("id"), path).count() == 3
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tables.write_snapshot(spark.range(1).toDF("id"), path)


def test_records_take_defaults_and_wrap_bare_strings(spark):
    df = spark.createDataFrame([('{"full_name": "Jo", "skills": null}',), ("{}",)], "j string")
    out = schemas.from_json_records(df, "j", schemas.PROFILES).orderBy(F.desc_nulls_last("full_name")).collect()
    assert out[0].full_name == "Jo" and out[0].skills == [] and out[0].experience == []
    assert out[1].full_name is None and out[1].raw_text == "" and out[1].metadata == "{}"
    bare = schemas.conform(spark.createDataFrame([("sql",)], "skills string"), schemas.PROFILES)
    assert bare.first().skills == ["sql"]
    assert schemas.to_json_records(bare).count() == 1


def test_history_orders(spark):
    analysis = spark.createDataFrame([(1, 7, 5, 10.0, T0), (2, 7, 5, 30.0, T1), (3, 7, 6, 20.0, T0)],
                                     "id long, profile_id long, posting_id long, match_score double, created_at timestamp")
    postings = spark.createDataFrame([(5, "Dev", "Acme"), (6, "Ops", "Beta")], "id long, job_title string, company string")
    people = spark.createDataFrame([(7, "Jo", "j@x.org")], "id long, full_name string, email string")
    assert [r.id for r in export.history_by_profile(analysis, postings).collect()] == [2, 1, 3]
    assert [r.id for r in export.history_by_posting(analysis, people, 1).orderBy("posting_id").collect()] == [2, 3]


def test_repeated_keys_without_an_order_give_the_same_row_in_any_order_of_the_batch(spark):
    kind = "id long, b string, a int, m map<string,int>"
    rows = [(1, "x", 2, {"k": 1}), (1, "y", 2, {"k": 1}), (1, "z", 1, {"k": 9}), (1, "y", 2, {"k": 2}), (1, None, None, None), (None, "n", 1, None), (None, "o", 1, None)]
    have = spark.createDataFrame([(1, "old", 0, None), (2, "kept", 0, None)], kind)
    want = [(1, "y", 2, {"k": 2}), (2, "kept", 0, None), (None, "o", 1, None)]
    for turned in (rows, rows[::-1], rows[3:] + rows[:3]):
        batch = spark.createDataFrame(turned, kind).repartition(3)
        got = sorted(map(tuple, store.upsert(batch, have, ["id"]).collect()), key=lambda r: (r[0] is None, r[0]))
        assert got == want
        patched = {r.id: r.b for r in store.patch(have, batch.drop("m"), "id", ["b"]).collect()}
        assert patched == {1: "y", 2: "kept"}
