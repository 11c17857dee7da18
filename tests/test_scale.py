"""What is made once, and how large a task's share is."""

from pyspark.sql import functions as F

from matchflow.operators import analysis, keywords, rewrite
from matchflow.operators.profiles import build_profiles
from matchflow.session import OPEN_SETTINGS, apply_settings


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tfidf_counts_each_text_once(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "apple plum"), (3, None), (4, "")], "doc_id long, text string")
    made = keywords.top_terms_tfidf(docs, "doc_id", "text", 2)
    assert "regexp_extract_all" not in plan(made)
    got = sorted((r["doc_id"], r["rank"], r["term"], r["score"]) for r in made.collect())
    assert got == [(1, 1, "apple", 1.386294), (1, 2, "pear", 1.386294), (2, 1, "plum", 1.386294), (2, 2, "apple", 0.693147)]


def test_section_requests_are_parsed_once(spark):
    texts = spark.createDataFrame([(1, "Ann Lee WORK EXPERIENCE Brick Works, Portland, OR Data Analyst Jan 2010 - Present • Built it TECHNICAL SKILLS SQL")],
                                  "profile_id long, raw_text string")
    made = rewrite.section_requests(build_profiles(texts).withColumn("summary", F.lit("Leads")))
    assert "Generate" not in plan(made)
    assert {r["section_type"] for r in made.collect()} == {"summary", "experience", "skills"}


def test_share_of_a_task_is_set_where_it_is_open(spark):
    other = spark.newSession()
    key = next(iter(OPEN_SETTINGS))
    other.conf.set(key, "8m")
    assert apply_settings(other).conf.get(key) == "8m"
    other.conf.unset(key)
    assert apply_settings(other).conf.get(key) == "16m"


def test_pairs_are_scored_from_profiles_parsed_once(spark):
    """Parsing is most of the work; what several steps read of a profile is stored."""
    texts = spark.createDataFrame([(1, "Ann Lee WORK EXPERIENCE Brick Works, Portland, OR Data Analyst Jan 2010 - Present • Built it TECHNICAL SKILLS SQL")],
                                  "profile_id long, raw_text string")
    people = build_profiles(texts)
    jobs = spark.createDataFrame([(7, "A Data Analyst with SQL and Java for Brick Works")], "posting_id long, description string")
    pairs = spark.createDataFrame([(7, 1)], "posting_id long, profile_id long")
    for made in (keywords.experience_overlap(pairs, jobs, people), analysis.match_scores(pairs, jobs, people), analysis.analyse(pairs, jobs, people)):
        assert "raw_text" not in plan(made)
        assert made.count() == 1
    assert keywords.experience_overlap(pairs, jobs, people).first()["experience_score"] == 20.0
