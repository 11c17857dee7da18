"""The registered queries and the shape of their plans."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchflow.operators import keywords, store
from matchflow.streaming.ingest import ingest_stream, stored_rows

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_every_query_runs_or_has_a_sane_plan(spark):
    for name, fn in entry.queries().items():
        text = plan(fn(spark, DATA))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["posting_id", "profile_id", "overall_score", "rank"] and rows.count() > 0


@needs_data
def test_scans_read_only_what_is_needed(spark):
    text = plan(entry.queries()["recent_rows"](spark, DATA))
    assert "TakeOrderedAndProject" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(entry.queries()["dup_groups"](spark, DATA))).group(1)
    assert schema == "doc_id:bigint,text:string"
    assert "PushedFilters: [IsNotNull(l_returnflag)" in plan(entry.queries()["lookup_rows"](spark, DATA))


def test_per_document_terms_do_not_shuffle(spark):
    docs = spark.createDataFrame([(1, "a text")], "id long, text string")
    assert "Exchange" not in plan(keywords.top_terms(docs, "id", "text"))


def test_first_arrivals_combine_before_the_shuffle(spark):
    text = plan(store.first_arrivals(spark.range(10).withColumn("h", F.lit("x")), "h", ["id"]))
    assert text.index("partial_min") > text.index("Exchange")  # the plan prints from the top


def test_stream_equals_batch_and_catches_old_copies(spark, tmp_path):
    schema = "doc_id long, text string, at timestamp"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(n, rows):
        spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(f"{source}/{n}")

    def run():
        arrivals = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
        ingest_stream(arrivals, out, state, "text", ["doc_id"], ts="at", lateness="1 hour").awaitTermination()

    arrive("a", [(1, "Hello", "2024-01-01 00:00:00"), (2, "hel lo", "2024-01-01 00:00:01"), (3, "other", "2024-01-01 00:00:02")])
    run()
    arrive("b", [(4, "HELLO", "2024-01-05 00:00:00"), (5, "new", "2024-01-05 00:00:01")])
    run()
    rows = stored_rows(spark, out).collect()
    assert len({r.fingerprint for r in rows}) == len(rows) == 3
    assert {r.text.lower().replace(" ", "") for r in rows} == {"hello", "other", "new"}


@pytest.mark.parametrize("files", [1, 3])
def test_stream_reads_a_table_of_one_file_or_of_a_folder(spark, tmp_path, files):
    docs = spark.createDataFrame([(k, f"text {k % 4}", "en", "web", 6) for k in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path / "tables")
    docs.repartition(files).write.parquet(f"{folder}/{'documents.parquet' if files > 1 else 'one'}")
    if files == 1:
        (part,) = (tmp_path / "tables/one").glob("part-*.parquet")
        (tmp_path / "tables/documents.parquet").write_bytes(part.read_bytes())
    rows = entry.queries()["ingest_stream_documents"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3]
