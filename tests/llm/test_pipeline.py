from pyspark.sql import functions as F

import corpus_pipeline
from matchflow.llm import packing

from .test_near import brute
from .test_tokens import WORDS, check_packing

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert not after.exceptAll(before).count()
        kept[name] = {r["doc_id"]: r["text"] for r in after.collect()}
        before = after
    whole = {r["doc_id"]: r for r in docs.collect()}
    # Every document has letters of a learned language here.
    assert len(kept["language ID"]) >= 0.99 * len(whole)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [(i in kept["quality classifier"], labels[i]) for i in kept["language ID"] if i in labels]
    assert sum(k for k, q in seen if q == 1) >= 0.97 * sum(q == 1 for _, q in seen)
    assert sum(not k for k, q in seen if q == 0) >= 0.7 * sum(q == 0 for _, q in seen)
    want = brute(list(kept["quality classifier"].items()), 5)
    assert set(kept["minhash near-dedup"]) == {i for i, (_, c) in want.items() if i == c}
    rows = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r["doc_id"] for r in rows} == set(kept["minhash near-dedup"])
    check_packing(rows, 4096)
    coder = packing.WordIds(open(WORDS).read())
    assert sum(r["length"] for r in rows) == sum(len(x) // 4 + 1 for x in coder(list(kept["minhash near-dedup"].values())))


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_rows_without_id_and_repeated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    row = docs.orderBy("doc_id").first()
    some = spark.createDataFrame([row, row, (None, "a text of its own with enough words", "en", "s", 1), (None, None, None, None, None)], docs.schema)
    assert corpus_pipeline.drop_near_copies(spark, some, SF).count() == 3


def test_near_copies_with_repeated_and_null_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    near = lambda c: text(c) + " more"
    rows = [(2, near("a")), (1, text("a")), (2, text("b")),  # an id with a copy and a text of its own
            (None, text("c")), (None, near("a")), (None, near("b")),  # without id: one kept, copies of documents with ids
            (None, text("d")), (None, near("d")), (None, text("d")),  # copies among themselves
            (3, text("e")), (3, near("e")), (3, text("e")), (4, None), (4, None), (4, ""), (5, "")]
    some = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, some, SF).collect()]
    groups = sorted((str(i), (t or "-")[0]) for i, t in got)
    assert groups == [("1", "a"), ("2", "b"), ("3", "e"), ("4", "-"), ("4", "-"), ("5", "-"), ("None", "c"), ("None", "d")]
    assert (2, text("b")) in got and (1, text("a")) in got


def test_any_column_names(spark):
    """Columns named like those the operators make come out as they went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    extra = ("features", "score", "predicted", "lang_pred", "row_no", "row", "place", "class", "id", "component_id", "kept", "no_id", "digest", "first")
    marked = docs
    for k, name in enumerate(extra):
        marked = marked.withColumn(name, F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")))
    for source in (marked, spark.createDataFrame(marked.collect(), marked.schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, source, SF)
            assert out.columns == marked.columns
            rows = out.collect()
            assert rows and all(r[name] == f"{name} {r['doc_id']}" for r in rows for name in extra)


def test_texts_that_stay_are_not_joined(spark, tmp_path):
    text = " ".join(f"w{n}" for n in range(60))
    rows = [(n, text if n % 2 == 0 else f"other {n} " * 20, f"s{n}") for n in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, slot string").write.parquet(str(tmp_path / "docs"))
    made = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    assert "Union" in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.columns == ["doc_id", "text", "slot"]
    assert sorted((r["doc_id"], r["slot"]) for r in made.collect()) == [(0, "s0"), (1, "s1"), (3, "s3"), (5, "s5"), (7, "s7")]


def test_texts_go_to_python_in_bounded_batches(spark):
    session = spark.newSession()
    corpus_pipeline.pack(session, session.createDataFrame([], "doc_id BIGINT, text STRING"), SF)  # any stage, also as the first of its session
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = session.range(0, 6000, 1, 1).select(F.repeat(F.lit("abc "), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    found = texts.mapInArrow(sizes, "n LONG, size LONG").collect()
    assert sum(r["n"] for r in found) == 6000
    assert max(r["size"] for r in found) < 8 << 20
