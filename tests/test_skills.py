import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchflow.functions import fixed
from matchflow.operators import analysis, keywords, skills


@pytest.mark.parametrize("text,found", [
    ("Python, C++ and node.js", ["c++", "node", "python"]), ("javascripty", []), ("use asp.net", ["asp.net"]),
    ("on .NET now", [".net"]), ("machine, learning", []), ("Machine Learning and problem-solving", ["machine learning", "problem-solving"]),
    ("K8s", ["kubernetes"]), (None, []), ("react.js", ["react"]),
])
def test_tagging(one, text, found):
    assert one(skills.skill_list("x"), text) == found


def test_large_taxonomies_join_to_the_same_tags(spark):
    docs = spark.createDataFrame([(1, "We use Node.js, c++ and Python on AWS"), (2, "good communication; js"), (3, "")], "doc_id long, text string")
    taxonomy = spark.createDataFrame(list(skills.DEFAULT_TAXONOMY), "term string, kind string")
    odd = taxonomy.unionByName(spark.createDataFrame([("!!", "tech"), (None, "tech")], taxonomy.schema))
    inline = sorted(map(tuple, skills.tag_skills(docs, [*skills.DEFAULT_TAXONOMY, ("!!", "tech")]).collect()))
    joined = sorted(map(tuple, skills.tag_skills(docs, odd).collect()))
    assert inline == joined and (1, "amazon web services") in joined


@pytest.mark.parametrize("skill,name,cls", [
    ("K8S ", "kubernetes", "kubernetes"), ("react.js", "react", "react"), ("React Native", "react native", "react"), ("other", "other", "other"),
])
def test_normal_forms(one, skill, name, cls):
    assert one(skills.normal_skill(F.col("x")), skill) == name and one(skills.skill_class(F.col("x")), skill) == cls


def test_classes_do_not_overlap():
    spellings = [s for group in fixed.SKILL_CLASSES.values() for s in group]
    assert len(spellings) == len(set(spellings))


def gap_of(spark, want, have):
    pairs = spark.createDataFrame([(1, 2)], "posting_id long, profile_id long")
    a = spark.createDataFrame([(1, want)], "posting_id long, skills array<string>")
    b = spark.createDataFrame([(2, have)], "profile_id long, skills array<string>")
    return skills.skill_gap(pairs, a, b).first()


def test_gap_keeps_spelling_and_partitions_the_skills(spark):
    row = gap_of(spark, ["python", "kubernetes", "sql"], ["py", "k8s"])
    assert row.matched == ["python", "kubernetes"] and row.missing == ["sql"]
    assert row.coverage == pytest.approx(2 / 3)
    assert gap_of(spark, [], ["py"]).coverage == 0.5


def test_top_terms_like_a_counter(spark):
    text = "beta alpha beta alpha gamma the The delta of it"
    kept = [w for w in re.findall(r"[a-z]{3,}", text.lower()) if w not in fixed.KEYWORD_STOPWORDS]
    rows = keywords.top_terms(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", 3).orderBy("rank").collect()
    assert [(r.term, r.n) for r in rows] == Counter(kept).most_common(3)


def test_missing_terms_are_ranked_substring_tests(spark):
    pairs = spark.createDataFrame([(1, 2)], "posting_id long, profile_id long")
    a = spark.createDataFrame([(1, "zeta zeta alpha alpha alpha data")], "posting_id long, description string")
    b = spark.createDataFrame([(2, "Database work")], "profile_id long, raw_text string")
    assert keywords.missing_terms(pairs, a, b).first().missing == ["alpha", "zeta"]
    assert keywords.missing_terms(pairs, a, b, n=1).first().missing == ["alpha"]


def test_overlap_without_posting_words(spark):
    pairs = spark.createDataFrame([(1, 2)], "posting_id long, profile_id long")
    a = spark.createDataFrame([(1, "the and of")], "posting_id long, description string")
    b = spark.createDataFrame([(2, "x")], "profile_id long, raw_text string")
    assert keywords.term_overlap(pairs, a, b).first().overlap == 0.5


PROFILE = ("profile_id long, raw_text string, skills array<string>, experience array<struct<company:string,title:string>>, "
           "education array<struct<institution:string>>, summary string, email string")


def analysed(spark, posting, profile):
    pairs = spark.createDataFrame([(1, 2)], "posting_id long, profile_id long")
    return analysis.analyse(pairs, spark.createDataFrame([(1, posting)], "posting_id long, description string"),
                            spark.createDataFrame([(2, *profile)], PROFILE)).first()


def test_score_without_experience_education_and_words(spark):
    row = analysed(spark, "r go c# ci/cd", ("", ["r", "go"], [], [], None, None))
    assert float(row.match_score) == 40.0
    assert row.matching_skills == ["go", "r"] and row.missing_skills == ["c#", "ci/cd"]
    assert row.improvement_suggestions == [
        fixed.SUGGEST_SKILLS % "'c#', 'ci/cd'", fixed.SUGGEST_EXPERIENCE, fixed.SUGGEST_SUMMARY, fixed.SUGGEST_LONGER,
        fixed.SUGGEST_EMAIL, fixed.SUGGEST_CUSTOMISE]


def test_full_score_and_other_advice(spark):
    text = "python engineer acme " + "word " * 1001
    row = analysed(spark, "python engineer acme degree word", (text, ["python"], [("Acme", "Engineer")], [("MIT",)], "s", "e@x"))
    # 60 + 20 + 10 and four of the five posting words
    assert float(row.match_score) == 98.0
    assert row.improvement_suggestions == [fixed.SUGGEST_NUMBERS, fixed.SUGGEST_SHORTER]
    assert row.analysis_metadata.posting_skills == 1 and row.keyword_suggestions == ["degree"]


def test_one_missing_skill_and_missing_education(spark):
    row = analysed(spark, "sql, education", ("saved $5", [], [("A", None)], [], "s", "e@x"))
    assert row.improvement_suggestions == [fixed.SUGGEST_ONE_SKILL % "sql", fixed.SUGGEST_EDUCATION, fixed.SUGGEST_LONGER, fixed.SUGGEST_CUSTOMISE]


def odd_pairs(spark):
    """Texts that are null, empty or without words, a profile that comes twice, and more than thirty terms."""
    text = "python sql " + " ".join(a + b for a in ("alpha", "beta", "gamma", "delta", "omega", "kappa") for b in ("one", "two", "three", "four", "five", "six", "nine"))
    jobs = spark.createDataFrame([(1, text + " degree kappanine kappanine"), (2, ""), (3, None), (4, "the and of"), (5, "java, alphaone")], "posting_id long, description string")
    who = (["python"], [("Acme", "Engineer")], [("MIT",)], None, "e@x")
    people = spark.createDataFrame([(1, "Alphaone betatwo sql", *who), (2, "kappanine in a long sentence", *who), (2, "python", *who), (3, "", *who), (4, None, *who)], PROFILE)
    pairs = spark.createDataFrame([(a, b) for a in range(1, 6) for b in range(1, 5)], "posting_id long, profile_id long")
    return pairs, jobs, people


def test_words_of_a_pair_travel_as_one_string_and_give_the_same_rows(spark):
    pairs, jobs, people = odd_pairs(spark)
    rows = analysis.analyse(pairs, jobs, people)
    moved = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "AS experience_score" in line]
    assert moved and not any(name in line for line in moved for name in ("p_terms#", "p_words#", "p_list#"))
    got = {(r.posting_id, r.profile_id): r.keyword_suggestions for r in rows.collect()}
    terms = {r.posting_id: r.terms for r in jobs.select("posting_id", keywords.top_term_list("description", 30).alias("terms")).collect()}
    assert len(terms[1]) == 30 and terms[1][0] == "kappanine"
    texts = {1: "alphaone betatwo sql", 3: ""}
    for (job, person), found in got.items():
        if person in texts:
            assert found == (None if terms[job] is None else [t for t in terms[job] if t not in texts[person]][:10])
    assert got[1, 4] == [] and got[2, 1] == [] and got[4, 1] == []
    scores = lambda df, c: sorted({(r.posting_id, r.profile_id, None if r[c] is None else float(r[c])) for r in df.collect()}, key=str)
    assert scores(rows, "match_score") == scores(analysis.match_scores(pairs, jobs, people), "match_score")


def test_suggestions_are_those_of_the_analysis_without_its_search_of_terms(spark, monkeypatch):
    pairs, jobs, people = odd_pairs(spark)
    each = analysis.analyse(pairs, jobs, people).select("posting_id", "profile_id", F.posexplode("improvement_suggestions").alias("position", "text"))
    want = sorted(map(tuple, each.collect()))

    def search(*_):
        raise AssertionError("suggestions need no terms")

    monkeypatch.setattr(analysis, "found_terms", search)
    made = analysis.suggestions(pairs, jobs, people)
    assert made.columns == each.columns and sorted(map(tuple, made.collect())) == want and want

