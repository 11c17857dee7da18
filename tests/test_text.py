import hashlib

import pytest
from pyspark.sql import functions as F

from matchflow.functions import fixed
from matchflow.functions.columns import SPACES, counted, strip, words
from matchflow.operators import profiles as prof
from matchflow.operators import text as ops


def test_spaces_are_those_of_python():
    assert set(SPACES) == {chr(i) for i in range(0x10000) if chr(i).isspace()}


@pytest.mark.parametrize("text", ["Hello World", "hello   world", "Hello\n\tWorld", "  HELLO World  ", "Hello World"])
def test_fingerprint_ignores_case_and_whitespace(one, text):
    assert one(ops.fingerprint("x"), text) == hashlib.sha256(b"helloworld").hexdigest()


def test_fingerprint_differs_and_is_never_null(one):
    assert one(ops.fingerprint("x"), "Data Scientist") != one(ops.fingerprint("x"), "Data Engineer")
    assert len(one(ops.fingerprint("x"), "")) == 64


def test_words_and_counts(one):
    assert one(words(F.col("x")), "élan vital café Abc_d the-end ab") == ["vital", "the", "end"]
    got = one(counted(words(F.col("x"))), "beta alpha beta")
    assert [(r.term, r.n, r.first) for r in got] == [("alpha", 1, 1), ("beta", 2, 0)]
    assert one(counted(words(F.col("x"))), "") == []


def test_strip(one):
    assert one(strip(F.col("x")), "  a b \n") == "a b"


def test_clean_text(one):
    assert one(ops.clean_text("x"), "Great  job.\n\n\n\n\nLine 2 Equal Opportunity Employer. All qualified\nmore") == "Great job.\n\nLine 2"


@pytest.mark.parametrize("text,field,value", [
    ("Job Title: Senior Data Scientist\nCompany: TechCorp Inc.\nLocation: San Francisco, CA\nApply here: https://techcorp.com/jobs/1", "company", "TechCorp Inc."),
    ("Job Title: Software Engineer", "job_title", "Software Engineer"),
    ("This position is based in Austin, TX.", "location", "Austin, TX"),
    ("This is a fully Remote position.", "location", "Remote"),
    ("Apply at https://company.com/jobs/12345", "apply_url", "https://company.com/jobs/12345"),
    ("Nothing here", "job_title", None),
])
def test_fields(spark, text, field, value):
    row = ops.extract_fields(spark.createDataFrame([(text,)], "description string")).first()
    assert row[field] == value and (field in row.found_fields) == (value is not None)
    assert row.description == text


def test_gazetteer_fills_only_gaps_with_the_earliest_longest_name(spark):
    docs = spark.createDataFrame([(1, "Red Hat of Salem, near Red Square", None, None), (2, "Salem", "Kept", "Kept")],
                                 "id long, description string, company string, location string")
    orgs = spark.createDataFrame([("Red",), ("Red Hat",)], "name string")
    places = spark.createDataFrame([("Red Square",), ("Salem",)], "name string")
    got = [tuple(r) for r in ops.fill_from_gazetteer(docs, orgs, places).select("company", "location").orderBy("company").collect()]
    assert got == [("Kept", "Kept"), ("Red Hat", "Salem")]


RESUME = (
    "Jane Doe jane@x.org (555) 123-4567 Portland, OR https://www.linkedin.com/in/jane-d/\n"
    "WORK EXPERIENCE Acme Corp, Portland, OR Software Engineer Jan 2020 - Present • Built a data pipeline. • Ran it well. • Led the team of data people\n"
    "SKILLS Python EDUCATION Oregon State University B.S. in Computer Science, June 2019 GPA: 3.8\n"
    "PERSONAL PROJECTS Playlist Maker (Java | React): • Created a playlist service for users SKILLS again"
)


@pytest.fixture(scope="module")
def profile(spark):
    texts = spark.createDataFrame([(1, RESUME)], "id long, raw_text string").withColumn("raw_text", prof.clean_profile("raw_text"))
    return prof.build_profiles(texts).withColumn("spans", prof.sections_of("raw_text")).first()


def test_contacts(profile):
    assert (profile.email, profile.phone, profile.location) == ("jane@x.org", " (555) 123-4567", "Portland, OR")
    assert profile.linkedin_url == "https://www.linkedin.com/in/jane-d/"


def test_degree_is_no_state(one):
    assert one(prof.location_of("x"), "Boston, MA then Austin, TX") is None
    assert one(prof.phone_of("x"), "call 123 456 789 now") == "123 456 789"


def test_sections_end_at_the_next_header_and_keep_the_first(profile):
    kinds = {s.section_type: s for s in profile.spans}
    assert set(kinds) == {"experience", "skills", "education", "projects"}
    assert kinds["skills"].text.strip() == "Python"
    for s in profile.spans:
        assert profile.raw_text[s.start:s.end] == s.text


def test_experience(profile):
    (job,) = profile.experience
    assert (job.company, job.title, job.dates) == ("Acme Corp", "Software Engineer", "Jan 2020 - Present")
    assert job.description == ["Built a data pipeline.", "Ran it well.", "Led the team of data people"]


def test_strict_bullets_lose_sentences(one):
    section = " Acme Corp, Salem, OR Engineer Jan 2020 - Present • Built a data pipeline.\n• Ran it very well.\n• Led the team of people"
    assert one(prof.experience_of(F.col("x"), strict=True), section)[0].description == ["Led the team of people"]


def test_company_before_the_title_when_there_is_no_place(one):
    assert one(prof.experience_of(F.col("x")), "Initech Data Analyst Mar 2015 – Dec 2019 • x")[0].company == "Initech"


def test_education(profile):
    (school,) = profile.education
    assert (school.institution, school.dates, school.gpa) == ("Oregon State University", "June 2019", "3.8")
    assert school.degree == "B.S."


def test_projects(profile):
    (project,) = profile.projects
    assert (project.name, project.technologies) == ("Playlist Maker", ["Java", "React"])
    assert project.description == ["Created a playlist service for users"]


def test_profile_provenance(profile):
    assert profile.skills == ["java", "python", "react"]
    assert profile.extraction_methods.regex == ["email", "phone", "linkedin", "skills", "projects"]


def test_summary(one):
    text = "Profile: " + "many words here " * 5 + "\n\nrest"
    assert one(prof.summary_of("x"), text) == ("many words here " * 5).strip()
    assert one(prof.summary_of("x"), "Summary: short skills") is None
    assert one(prof.summary_of("x"), "Summary: " + "a" * 600 + " skills") == "a" * 600
    assert one(prof.summary_of("x", 2000, 500), "Summary: " + "a" * 600 + " skills") == "a" * 500 + "..."


def test_corrections_replace_present_keys_and_real_lists(spark, profile):
    base = spark.createDataFrame([(1, RESUME)], "id long, raw_text string")
    answers = spark.createDataFrame([
        (1, 1, '{"email": null, "full_name": "Jane", "skills": "x", "projects": [{"name": "P", "technologies": "sql", "bullets": ["did it"], "url": "u"}]}'),
        (1, 2, '{"full_name": "Jane D"}')], "record_id long, pass int, json string")
    row = prof.overlay_corrections(prof.build_profiles(base), answers).first()
    assert row.email is None and row.full_name == "Jane D" and row.skills == ["java", "python", "react"]
    (project,) = row.projects
    assert (project.name, project.technologies, project.description, project.url) == ("P", ["sql"], ["did it"], "u")
    assert row.corrected and row.phone is not None


def test_rewrites(spark):
    base = prof.build_profiles(spark.createDataFrame([(1, RESUME)], "id long, raw_text string"))
    rewrites = spark.createDataFrame([
        (1, "experience", 0, "old", 1), (1, "experience", 0, "- Led x\n\n* Built y\n", 2), (1, "experience", 5, "- z", 3),
        (1, "summary", 3, " New ", 4), (1, "skills", 0, "s", 5), (9, "summary", 0, "n", 6)],
        "profile_id long, section_type string, section_index int, new_text string, n int")
    done, rejected = prof.apply_rewrites(base, rewrites, order="n")
    row = done.first()
    assert row.experience[0].description == ["Led x", "Built y"] and row.summary == "New"
    assert row.projects[0].name == "Playlist Maker"
    assert sorted((r.n, r.reason) for r in rejected.collect()) == [
        (3, "index out of range"), (5, "unsupported section type"), (6, "unknown profile")]


def test_section_headers_cover_all_kinds():
    assert set(fixed.SECTION_HEADERS) == {"experience", "education", "skills", "projects"}
