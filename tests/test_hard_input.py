"""Input the made-up tables never hold: long runs, odd markup, repeated keys, nulls."""

import time

import pytest
from pyspark.sql import functions as F

from matchflow.operators import match, postings, profiles, store, text
from matchflow.operators.vectors import near_dups


@pytest.mark.parametrize("raw", [
    "EDUCATION " + "word " * 20_000, "EDUCATION University of " + "Word " * 20_000, "EDUCATION " + "Word " * 20_000 + "Reed College",
    "WORK EXPERIENCE " + "word " * 20_000 + "Jan 2010 - Present " + "word " * 20_000, "PROJECTS " + "word " * 20_000 + "(x) more", "Summary: " + "word " * 20_000,
])
def test_long_runs_of_words_end_in_seconds(spark, raw):
    started = time.time()
    row = profiles.build_profiles(spark.createDataFrame([(1, raw)], "id int, raw_text string"), summaries=True).collect()
    assert len(row) == 1 and time.time() - started < 60


@pytest.mark.parametrize("section,names", [
    ("University of Oregon, Reed College, June 2010", ["University of Oregon", "Reed College"]),
    ("Boston College Boston University then", ["Boston College", "Boston University"]),
    ("at Lewis and Clark College, Foo State University", ["at Lewis and Clark College", "Foo State University"]),
    ("Harvard Extension University, 2010", ["Harvard Extension University"]),
])
def test_institutions(spark, section, names):
    df = spark.createDataFrame([(1, "EDUCATION " + section)], "id int, raw_text string")
    assert [r["institution"] for r in profiles.education_entries(df).orderBy("index").collect()] == names


def test_sections_keep_first_of_each_kind_in_order(spark):
    df = spark.createDataFrame([(1, "SKILLS a EDUCATION b SKILLS c WORK EXPERIENCE d EDUCATION e")], "id int, raw_text string")
    got = [(r["section_type"], r["text"], r["start"], r["end"]) for r in profiles.segment(df).collect()]
    assert got == [("skills", " a ", 6, 9), ("education", " b ", 18, 21), ("experience", " d ", 45, 48)]


@pytest.mark.parametrize("html,company", [
    ('<img class="company-logo"><div class="company">Acme</div><p>rest of the page</p>', "Acme"),
    ("<div class=company>Acme</div><p>rest</p>", "Acme"),
    ('<div class="company">Caf&eacute; &#8211; Bar &#x2013; &amp; Co &#99999999; &#39;s</div>', "Café – Bar – & Co &#99999999; 's"),
])
def test_selected_text(spark, html, company):
    page = spark.createDataFrame([(1, html)], "page_id int, html string")
    row = postings.selector_postings(page, selectors={"company": ("[class*=\"company-logo\"]", ".company")} | {
        k: ("#none",) for k in ("job_title", "location", "description")}).first()
    assert row["company"] == company


def test_repeated_json_keys_take_the_last(spark):
    answers = postings.parse_answers(spark.createDataFrame(
        [(1, 1, '{"a": 1, "a": 2}'), (1, 2, '{"b": "x"}')], "record_id int, pass int, response_text string"))
    assert {r["status"] for r in answers.collect()} == {"parsed"}
    assert postings.merge_passes(answers).first()["fields"] == {"a": "2", "b": "x"}


def test_last_of_several_answers_by_order(spark):
    df = spark.createDataFrame([(1, 1, '{"a": "z old"}', 1), (1, 1, '{"a": "a new"}', 2)], "record_id int, pass int, json string, at int")
    assert postings.merge_passes(df, order="at").first()["fields"] == {"a": "a new"}


def test_repeated_keys_in_a_batch(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1), (2, "d", 1)], "k int, v string, n int")
    assert sorted(map(tuple, store.upsert(new, old, ["k"], order=["n"]).collect())) == [(1, "c"), (2, "d")]
    assert sorted(r["k"] for r in store.upsert(new, old, ["k"]).collect()) == [1, 2]
    assert [tuple(r) for r in store.patch(old, new, "k", ["v"], order=["n"]).collect()] == [(1, "c")]
    vectors = spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "k int, v string, n int")
    assert [tuple(r) for r in store.vector_put(old, vectors, "k", "v", order=["n"]).collect()] == [(1, "x")]


def test_near_dups_of_rows_without_vector(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_dups(df, 0.9).collect())) == [(1, 1), (2, 1), (3, 3)]


def test_names_of_any_length(spark):
    docs = spark.createDataFrame([(1, "He left the big old firm of Smith and Sons Limited, then Acme.")], "id int, body string")
    names = spark.createDataFrame([("The Big Old Firm of Smith and Sons Limited",), ("Acme",), ("the big",), ("!!",), (None,)], "name string")
    assert text.first_mentions(docs, names, "id", "body").first()["name"] == "The Big Old Firm of Smith and Sons Limited"
    far = spark.createDataFrame([(1, "x " * 9000 + "Acme")], "id int, body string")
    assert text.first_mentions(far, names, "id", "body").first()["name"] == "Acme"
    assert text.first_mentions(far, names, "id", "body", chars=5000).count() == 0
    assert text.first_mentions(docs, names.limit(0), "id", "body").count() == 0


def test_many_fallback_profiles(spark):
    postings_ = spark.createDataFrame([(1,), (2,)], "posting_id long")
    people = spark.range(1500).select(F.col("id").alias("profile_id"), F.timestamp_seconds("id").alias("created_at"))
    got = match.fallback_candidates(postings_, spark.createDataFrame([(2,)], "posting_id long"), people, 1200).collect()
    assert {r["posting_id"] for r in got} == {1} and {r["profile_id"] for r in got} == set(range(300, 1500))


def test_pair_scores_group_nothing_behind_the_join(spark):
    sections = spark.createDataFrame([(1, "summary", 0, [1.0, 0.0]), (1, "experience", 0, [0.0, 1.0]), (1, "experience", 1, [1.0, 0.0]), (3, "skills", 0, None)],
                                     "profile_id long, section_type string, section_index int, embedding array<float>")
    posting = spark.createDataFrame([(7, [1.0, 0.0])], "posting_id long, embedding array<float>")
    pairs = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "posting_id long, profile_id long")
    inside = sorted(map(tuple, match.score_pairs(pairs, sections, posting).collect()))
    grouped = match.overall_score(match.score_sections(pairs, sections, posting, keep_pairs=True))
    assert inside == sorted(map(tuple, grouped.collect())) and inside[0][2] > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = match.score_pairs(pairs, sections, posting)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Aggregate" not in plan[:plan.index("SortMergeJoin")]
