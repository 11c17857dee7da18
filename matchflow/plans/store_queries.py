"""Queries on table maintenance and history."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import buckets, export, store
from ..operators.text import fingerprint
from ..session import checkpoint_dir
from ..sources.files import scan_files
from ..streaming.ingest import ingest_stream, stored_rows
from .registry import query
from .views import WS, spread, table


@query("""
SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS day
FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100
""")
def recent_rows(spark, sf):
    rows = store.recent(table(spark, sf, "orders"), "o_orderdate", "o_orderkey", 100,
                        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    return rows.select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
""")
def lookup_rows(spark, sf):
    keys = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return store.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), keys, "o_orderkey")


@query("""
SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS p_size FROM lineitem l
WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size = l.l_suppkey)
""")
def lookup_exists(spark, sf):
    keys = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("p_size"))
    return store.lookup(table(spark, sf, "part"), keys, ["p_partkey", "p_size"], exists=True)


@query("""
SELECT parse_filename(filename) AS file, size AS length,
       CASE WHEN size <= 1000000 THEN sha256(content) END AS file_hash,
       CASE WHEN size > 1000000 THEN 'file too large' END AS reason
FROM read_blob('/root/testdata/sf0.01/*.parquet')
""")
def file_inventory(spark, sf):
    files = scan_files(spark, sf, ("parquet",), 1_000_000)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "file_hash", "reason")


_HASHED = f"SELECT doc_id, sha256(regexp_replace(lower(text), '{WS}+', '', 'g')) AS fingerprint FROM documents"
_UNIQUE = f"""
WITH d AS ({_HASHED}),
store AS (SELECT DISTINCT fingerprint FROM d JOIN labels USING (doc_id)),
firsts AS (SELECT fingerprint, min(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY fingerprint)
"""


def _documents(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return docs.withColumn("fingerprint", fingerprint("text"))


def _labelled(spark, sf, docs):
    return docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query(_UNIQUE + "SELECT doc_id, fingerprint FROM firsts WHERE fingerprint NOT IN (SELECT fingerprint FROM store)")
def append_unique(spark, sf):
    docs = _documents(spark, sf)
    new, _ = store.append_unique(docs.select("doc_id", "fingerprint"), _labelled(spark, sf, docs), "fingerprint", ["doc_id"])
    return new


@query(_UNIQUE + """
SELECT outcome, CAST(sum(n) AS BIGINT) AS rows FROM (
  SELECT 'dup_in_store' AS outcome, n FROM firsts WHERE fingerprint IN (SELECT fingerprint FROM store)
  UNION ALL SELECT 'inserted', 1 FROM firsts WHERE fingerprint NOT IN (SELECT fingerprint FROM store)
  UNION ALL SELECT 'dup_in_batch', n - 1 FROM firsts WHERE fingerprint NOT IN (SELECT fingerprint FROM store)
) GROUP BY outcome
""")
def append_unique_report(spark, sf):
    docs = _documents(spark, sf)
    _, report = store.append_unique(docs.select("doc_id", "fingerprint"), _labelled(spark, sf, docs), "fingerprint", ["doc_id"])
    return report


@query(f"""
WITH d AS ({_HASHED}) SELECT fingerprint, min(doc_id) AS doc_id FROM d GROUP BY fingerprint
""")
def ingest_stream_documents(spark, sf):
    """The documents as a file stream; the rows are those of one batch run over an empty store."""
    schema = T.StructType.fromDDL("doc_id bigint, text string, lang string, source string, n_chars bigint")
    # A pattern, as a stream takes no single file by its name; the table may be a file or a folder of part files.
    arrivals = spark.readStream.schema(schema).parquet(f"{sf}/{{documents}}.parquet")
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    ingest_stream(arrivals.select("doc_id", "text"), f"{root}/store", f"{root}/state", "text", ["doc_id"]).awaitTermination()
    return stored_rows(spark, f"{root}/store").select("fingerprint", "doc_id")


_LATEST = """
SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus,
       arg_max(o_totalprice, o_orderkey) AS o_totalprice
FROM orders WHERE o_orderdate {} DATE '1997-01-01' GROUP BY o_custkey
"""


def _halves(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    latest = lambda part: store.latest_per_key(part.drop("o_orderdate"), ["o_custkey"], ["o_orderkey"])
    split = F.lit("1997-01-01").cast("date")
    old, new = latest(orders.filter(F.col("o_orderdate") < split)), latest(orders.filter(F.col("o_orderdate") >= split))
    stamp = lambda df, day: df.withColumn("updated", F.lit(day).cast("date"))
    return stamp(old, "1997-01-01"), stamp(new, "1998-01-01")


@query(f"""
SELECT coalesce(n.o_custkey, s.o_custkey) AS o_custkey, coalesce(n.o_orderkey, s.o_orderkey) AS o_orderkey,
       coalesce(n.o_orderstatus, s.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, s.o_totalprice) AS o_totalprice,
       CASE WHEN n.o_custkey IS NULL THEN DATE '1997-01-01' ELSE DATE '1999-01-01' END AS updated
FROM ({_LATEST.format('<')}) s FULL JOIN ({_LATEST.format('>=')}) n ON s.o_custkey = n.o_custkey
""")
def upsert_snapshot(spark, sf):
    old, new = _halves(spark, sf)
    return store.upsert(new, old, ["o_custkey"], F.lit("1999-01-01").cast("date"), stamp="updated")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 100 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 100 = 1 THEN DATE '1999-01-01' ELSE CAST(o_orderdate AS DATE) END AS updated FROM orders
UNION ALL SELECT -o_orderkey - 1, 'N', o_totalprice, DATE '1999-01-01' FROM orders WHERE o_orderkey % 100 = 2
""")
def upsert_buckets(spark, sf):
    """All orders as a bucketed table; edits of about one in a hundred and as many new rows reach their buckets only."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("updated"))
    stored = buckets.Buckets(f"{checkpoint_dir(spark)}/orders-{uuid.uuid4().hex}", ("o_orderkey",), 64)
    stored.create(orders)
    edits = orders.where("o_orderkey % 100 = 1").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    fresh = orders.where("o_orderkey % 100 = 2").withColumns({"o_orderkey": -F.col("o_orderkey") - 1, "o_orderstatus": F.lit("N")})
    stored.change(edits.unionByName(fresh).drop("updated"),
                  lambda rows, batch: store.upsert(batch, rows, ["o_orderkey"], F.lit("1999-01-01").cast("date"), stamp="updated"))
    return stored.read(spark)


@query(f"""
WITH s AS ({_LATEST.format('<')}), n AS ({_LATEST.format('>=')}),
j AS (SELECT s.o_custkey AS sk, n.o_custkey AS nk, s.o_orderkey AS so, n.o_orderkey AS no,
             s.o_orderstatus AS ss, n.o_orderstatus AS ns, s.o_totalprice AS sp, n.o_totalprice AS np,
             n.o_custkey IS NOT NULL AND (s.o_custkey IS NULL OR s.o_orderstatus <> n.o_orderstatus) AS take
      FROM s FULL JOIN n ON s.o_custkey = n.o_custkey)
SELECT coalesce(sk, nk) AS o_custkey, CASE WHEN take THEN no ELSE so END AS o_orderkey,
       CASE WHEN take THEN ns ELSE ss END AS o_orderstatus, CASE WHEN take THEN np ELSE sp END AS o_totalprice,
       CASE WHEN take THEN DATE '1999-01-01' ELSE DATE '1997-01-01' END AS updated
FROM j
""")
def upsert_changed(spark, sf):
    old, new = _halves(spark, sf)
    merged = store.upsert_if_changed(new, old, ["o_custkey"], "o_orderstatus", F.lit("1999-01-01").cast("date"), stamp="updated")
    return merged


@query("""
SELECT c_custkey, coalesce(CASE WHEN s_acctbal >= 0 THEN s_name END, c_name) AS c_name,
       coalesce(s_acctbal, c_acctbal) AS c_acctbal, c_mktsegment,
       CASE WHEN s_suppkey IS NOT NULL THEN DATE '2024-01-01' END AS updated_at
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
""")
def patch_rows(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").withColumn(
        "updated_at", F.lit(None).cast("date"))
    edits = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("c_name"),
        F.col("s_acctbal").alias("c_acctbal"))
    return store.patch(base, edits, "c_custkey", ["c_name", "c_acctbal"], F.lit("2024-01-01").cast("date"))


@query("""
SELECT 'customer' AS "table", count(*) AS deleted FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
""")
def delete_cascade_report(spark, sf):
    customers, orders, lines = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    doomed = customers.filter("c_acctbal < 0").select("c_custkey")
    _, first = store.delete_cascade(doomed, "c_custkey", customers, {"orders": (orders, "o_custkey")})
    gone = store.lookup(orders, doomed.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    _, second = store.delete_cascade(gone, "o_orderkey", orders, {"lineitem": (lines, "l_orderkey")})
    named = first.withColumn("table", F.when(F.col("table") == "parent", "customer").otherwise(F.col("table")))
    return named.unionByName(second.filter("table = 'lineitem'"))


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (
  SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
""")
def delete_cascade(spark, sf):
    customers, orders, lines = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    doomed = customers.filter("c_acctbal < 0").select("c_custkey")
    gone = store.lookup(orders, doomed.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    left, _ = store.delete_cascade(gone, "o_orderkey", orders, {"lineitem": (lines, "l_orderkey")})
    return left["lineitem"].select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))


@query("""
SELECT 'orders' AS table_name, 'unique' AS rule, 'o_orderkey' AS column_name, o_orderkey::VARCHAR AS value, count(*) AS rows
FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'orders', 'unique', 'o_custkey|o_orderdate',
       o_custkey::VARCHAR || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), count(*)
FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1
UNION ALL SELECT 'orders', 'not_null', 'o_custkey', NULL, count(*) FROM orders WHERE o_custkey IS NULL HAVING count(*) > 0
UNION ALL SELECT 'orders', 'not_null', 'o_orderdate', NULL, count(*) FROM orders WHERE o_orderdate IS NULL HAVING count(*) > 0
UNION ALL SELECT 'orders', 'foreign', 'o_custkey', o_custkey::VARCHAR, count(*)
FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) GROUP BY o_custkey
UNION ALL SELECT 'orders', 'max_length', 'o_orderpriority', length(o_orderpriority)::VARCHAR, count(*)
FROM orders WHERE length(o_orderpriority) > 8 GROUP BY length(o_orderpriority)
UNION ALL SELECT 'lineitem', 'unique', 'l_orderkey|l_linenumber', l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR, count(*)
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'lineitem', 'foreign', 'l_orderkey', l_orderkey::VARCHAR, count(*)
FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY l_orderkey
UNION ALL SELECT 'lineitem', 'range', 'l_discount', l_discount::VARCHAR, count(*)
FROM lineitem WHERE l_discount < 0.0 OR l_discount > 0.05 GROUP BY l_discount
UNION ALL SELECT 'labels', 'foreign', 'doc_id', doc_id::VARCHAR, count(*)
FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY doc_id
""")
def constraint_report(spark, sf):
    names = ("customer", "orders", "lineitem", "labels", "embeddings")
    rules = {
        "orders": store.TableRules(unique=[["o_orderkey"], ["o_custkey", "o_orderdate"]], not_null=["o_custkey", "o_orderdate"],
                                   foreign={"o_custkey": ("customer", "c_custkey")}, max_length={"o_orderpriority": 8}),
        "lineitem": store.TableRules(unique=[["l_orderkey", "l_linenumber"]], foreign={"l_orderkey": ("orders", "o_orderkey")},
                                     ranges={"l_discount": (0.0, 0.05)}),
        "labels": store.TableRules(foreign={"doc_id": ("embeddings", "vec_id")}),
    }
    return store.constraint_report({n: table(spark, sf, n) for n in names}, rules)


_STATS = {"customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
          "labels": ("doc_id", "quality", "toxic"), "pages": ("page_id", "url", "html")}


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, "
    f"CAST((count(*) - count({c})) / count(*) AS DOUBLE) AS null_rate FROM {t}"
    for t, cols in _STATS.items() for c in cols))
def table_stats(spark, sf):
    return store.table_stats({t: table(spark, sf, t).select(*cols) for t, cols in _STATS.items()})


@query("""
SELECT doc_id, lang, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS head
FROM documents LEFT JOIN embeddings ON doc_id = vec_id
""")
def vector_put(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang").withColumn("embedding", F.lit(None).cast("array<float>"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    done = store.vector_put(docs, vectors, "doc_id", "embedding")
    return done.select("doc_id", "lang", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("dims"),
                       F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("head"))


# --- history ----------------------------------------------------------------------------------------------------


def _analysis(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("posting_id"),
        F.col("l_suppkey").alias("profile_id"), F.col("l_extendedprice").alias("match_score"),
        F.to_date("l_shipdate").alias("created_at"))


_ANALYSIS = ("SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS posting_id, l_suppkey AS profile_id, "
             "l_extendedprice AS match_score, CAST(l_shipdate AS DATE) AS created_at FROM lineitem")


def _titles(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("job_title"), F.col("p_brand").alias("company"))


@query(f"""
SELECT a.*, p_name AS job_title, p_brand AS company FROM ({_ANALYSIS}) a JOIN part ON p_partkey = posting_id
""")
def history_by_profile(spark, sf):
    return export.history_by_profile(_analysis(spark, sf), _titles(spark, sf))


@query(f"""
SELECT * FROM (SELECT a.*, p_name AS job_title, p_brand AS company,
  row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, id) AS place
  FROM ({_ANALYSIS}) a JOIN part ON p_partkey = posting_id) WHERE place <= 5
""")
def history_by_profile_top(spark, sf):
    return export.history_by_profile(_analysis(spark, sf), _titles(spark, sf), 5).withColumn("place", F.col("place").cast("bigint"))


@query(f"""
SELECT * FROM (SELECT a.*, s_name AS full_name, 'mail@' || s_name AS email,
  row_number() OVER (PARTITION BY posting_id ORDER BY match_score DESC, id) AS place
  FROM ({_ANALYSIS}) a JOIN supplier ON s_suppkey = profile_id) WHERE place <= 3
""")
def history_by_posting_top(spark, sf):
    people = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), F.concat(F.lit("mail@"), F.col("s_name")).alias("email"))
    return export.history_by_posting(_analysis(spark, sf), people, 3).withColumn("place", F.col("place").cast("bigint"))
