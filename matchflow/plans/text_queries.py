"""Queries on posting texts and profile texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import profiles as prof
from ..operators import text as ops
from . import views as v
from .registry import query
from .views import WS, postings, profile_texts, profiles, spread, table

# --- postings ------------------------------------------------------------------------------------------


def _sql_clean(text: str) -> str:
    out = text
    for phrase in fixed.BOILERPLATE:
        out = f"regexp_replace({out}, '(?is){phrase}.*', '', 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim(regexp_replace({out}, ' {{2,}}', ' ', 'g'), ' ' || chr(10))"


@query(f"""
SELECT posting_id, {_sql_clean('description')} AS clean,
       CAST(length(description) - length({_sql_clean('description')}) AS BIGINT) AS removed_chars
FROM ({v.POSTINGS_SQL})
""")
def clean_postings(spark, sf):
    return ops.clean_postings(postings(spark, sf)).select(
        "posting_id", "clean", F.col("removed_chars").cast("bigint").alias("removed_chars"))


@query(" UNION ALL ".join(f"""
SELECT source, '{p}' AS phrase, count(*) AS texts, CAST(sum(length(regexp_extract(description, '(?is){p}.*'))) AS BIGINT) AS removed_chars
FROM ({v.POSTINGS_SQL}) WHERE regexp_matches(description, '(?is){p}') GROUP BY source
""" for p in fixed.BOILERPLATE))
def boilerplate_stats(spark, sf):
    return ops.boilerplate_stats(postings(spark, sf), "source")


def _sql_ladder(text: str, patterns) -> str:
    values = []
    for p in patterns:
        found = f"regexp_replace(trim(regexp_extract({text}, '{p}', 1), ' ' || chr(9) || chr(10) || chr(13)), '{WS}+', ' ', 'g')"
        values.append(f"CASE WHEN length({found}) > 1 THEN {found} END")
    return "coalesce(" + ", ".join(values) + ")"


def _sql_fields(text: str) -> str:
    return ", ".join(f"{_sql_ladder(text, p)} AS {n}" for n, p in fixed.POSTING_LADDER.items())


@query(f"SELECT posting_id, {_sql_fields('description')} FROM ({v.POSTINGS_SQL})")
def posting_fields(spark, sf):
    return ops.extract_fields(postings(spark, sf)).select("posting_id", *fixed.POSTING_LADDER)


@query(f"SELECT doc_id, {_sql_fields('text')} FROM documents")
def document_fields(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return ops.extract_fields(docs, "text").select("doc_id", *fixed.POSTING_LADDER)


@query(f"WITH f AS (SELECT doc_id, {_sql_fields('text')} FROM documents) " + " UNION ALL ".join(
    f"SELECT '{n}' AS field, count({n}) AS filled, count(*) AS rows, count({n}) / count(*)::DOUBLE AS rate FROM f"
    for n in fixed.POSTING_LADDER))
def field_fill_rates(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return ops.fill_rates(ops.extract_fields(docs, "text"), list(fixed.POSTING_LADDER))


@query("""
SELECT p_partkey AS id, p_brand AS company,
       CASE WHEN p_size % 2 = 0 THEN 'Known Place' ELSE n_name END AS location
FROM part JOIN nation ON n_nationkey = p_size % 25
""")
def fill_from_gazetteer(spark, sf):
    """Companies are the brands, places the nations; half of the postings know their place."""
    nation = table(spark, sf, "nation")
    near = nation.select(F.col("n_nationkey").alias("near"), F.col("n_name").alias("place"))
    docs = table(spark, sf, "part").withColumn("near", F.col("p_size") % 25).join(near, "near").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("One "), "p_name", F.lit(" by "), "p_brand", F.lit(", made in "), "place", F.lit(".")).alias("description"),
        F.lit(None).cast("string").alias("company"),
        F.when(F.col("p_size") % 2 == 0, F.lit("Known Place")).alias("location"))
    orgs = table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    return ops.fill_from_gazetteer(docs, orgs, nation.select(F.col("n_name").alias("name"))).select("id", "company", "location")


#: Every third text has lost the second letter of its place, every other third has its last one twice.
_PLACE = ("CASE p_size % 3 WHEN 0 THEN substring(n_name, 1, 1) || substring(n_name, 3) WHEN 1 THEN n_name || substring(n_name, length(n_name), 1) ELSE n_name END")
_MADE_IN = f"'One ' || p_name || ' by ' || p_brand || ', made in ' || {_PLACE} || '.'"


@query(f"""
WITH docs AS (SELECT p_partkey AS id, regexp_extract_all(lower({_MADE_IN}), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM part JOIN nation ON n_nationkey = p_size % 25),
places AS (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM docs),
names AS (SELECT n_name AS name, string_split(lower(n_name), ' ') AS phrase, least(2, length(n_name) // 4) AS allowed FROM nation),
met AS (SELECT id, name, pos, allowed, list_sum(list_transform(range(1, len(phrase) + 1), lambda j: levenshtein(ws[pos + j - 1], phrase[j]))) AS edits
        FROM places, names WHERE pos + len(phrase) - 1 <= len(ws))
SELECT id, arg_min(name, (pos, edits, -length(name), name)) AS name FROM met WHERE edits <= allowed GROUP BY id
""")
def misspelt_places(spark, sf):
    """The SQL measures every name at every word."""
    places = table(spark, sf, "nation").select("n_nationkey", "n_name")
    docs = table(spark, sf, "part").join(places, F.col("n_nationkey") == F.col("p_size") % 25).selectExpr("p_partkey AS id", f"{_MADE_IN} AS description")
    return ops.misspelt_mentions(docs, places.select(F.col("n_name").alias("name")), "id", "description")


@query(f"""
SELECT sha256(regexp_replace(lower(text), '{WS}+', '', 'g')) AS fingerprint, min(doc_id) AS keeper, count(*) AS copies
FROM documents GROUP BY 1
""")
def dup_groups(spark, sf):
    return ops.dup_groups(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


# --- contacts, sections, entries ------------------------------------------------------------------------------


@query(f"""
SELECT c_custkey AS profile_id, {v.EMAIL} AS email, ' ' || {v.PHONE} AS phone, {v.LINKEDIN} AS linkedin_url, {v.FOUND_LOCATION} AS location
FROM customer
""")
def profile_contacts(spark, sf):
    return prof.extract_contacts(profile_texts(spark, sf)).select("profile_id", "email", "phone", "linkedin_url", "location")


def _sql_first(pattern: str) -> str:
    return f"nullif(regexp_extract(text, '{pattern}', 0), '')"


@query(f"""
SELECT doc_id, {_sql_first(fixed.EMAIL)} AS email, coalesce({', '.join(_sql_first(p) for p in fixed.PHONES)}) AS phone,
       {_sql_first(fixed.LINKEDIN)} AS linkedin_url
FROM documents
""")
def document_contacts(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return prof.extract_contacts(docs, "text").select("doc_id", "email", "phone", "linkedin_url")


@query(f"""
SELECT email, count(*) AS profiles, min(doc_id) AS first FROM (SELECT doc_id, {_sql_first(fixed.EMAIL)} AS email FROM documents)
WHERE email IS NOT NULL GROUP BY email
""")
def people_by_email(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return prof.people(docs.select("doc_id", prof.email_of("text").alias("email")), "doc_id")


_SECTIONS = (
    ("experience", v.HEAD + " || ' WORK EXPERIENCE'", f"' ' || {v.EXPERIENCE} || ' '"),
    ("education", None, f"' ' || {v.EDUCATION} || ' '"),
    ("skills", None, f"' ' || {v.SKILLS} || ' '"),
    ("projects", None, f"' ' || {v.PROJECT}"),
)


@query(" UNION ALL ".join(
    f"SELECT c_custkey AS profile_id, '{kind}' AS section_type, {body} AS text FROM customer" for kind, _, body in _SECTIONS))
def segment_profiles(spark, sf):
    return prof.segment(profile_texts(spark, sf), "raw_text", "profile_id").select("profile_id", "section_type", "text")


@query(f"""
SELECT c_custkey AS profile_id, CAST(length({v.HEAD} || ' WORK EXPERIENCE') AS BIGINT) AS starts,
       CAST(length({v.HEAD} || ' WORK EXPERIENCE ' || {v.EXPERIENCE} || ' ') AS BIGINT) AS ends
FROM customer
""")
def experience_spans(spark, sf):
    rows = prof.segment(profile_texts(spark, sf), "raw_text", "profile_id").filter("section_type = 'experience'")
    return rows.select("profile_id", F.col("start").cast("bigint").alias("starts"), F.col("end").cast("bigint").alias("ends"))


@query(f"""
SELECT c_custkey AS profile_id, 0::BIGINT AS index, {v.COMPANY1} AS company, {v.TITLE1} AS title, {v.DATES1} AS dates,
       {v.BULLET1} || '; ' || {v.FOUND_BULLET2} AS bullets FROM customer
UNION ALL
SELECT c_custkey, 1, {v.COMPANY2}, 'Administrator', {v.DATES2}, {v.BULLET3} FROM customer
""")
def experience_entries(spark, sf):
    rows = prof.experience_entries(profile_texts(spark, sf), key="profile_id")
    return rows.select("profile_id", F.col("index").cast("bigint").alias("index"), "company", "title", "dates",
                       F.array_join("description", "; ").alias("bullets"))


@query(f"""
SELECT c_custkey AS profile_id, {v.SCHOOL} AS institution, 'Bachelor of Science' AS degree, 'Computer Science' AS field,
       {v.EDU_DATE} AS dates, {v.GPA} AS gpa FROM customer
""")
def education_entries(spark, sf):
    return prof.education_entries(profile_texts(spark, sf), key="profile_id").drop("index")


_LOOSE_1 = "lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || '/' || CAST(2000 + c_custkey % 20 AS STRING)"
_LOOSE_2 = "CAST(1990 + c_nationkey AS STRING) || ' - present'"
_LOOSE = f"'WORK EXPERIENCE helped out since ' || {_LOOSE_1} || ' and ' || {_LOOSE_2} || ' EDUCATION Bachelor of Science GPA: ' || {v.GPA}"


@query(f"""
SELECT c_custkey AS profile_id, {_LOOSE_1} AS dates, NULL AS degree, NULL AS gpa FROM customer
UNION ALL SELECT c_custkey, {_LOOSE_2}, NULL, NULL FROM customer
UNION ALL SELECT c_custkey, NULL, 'Bachelor of Science', {v.GPA} FROM customer
""")
def loose_entries(spark, sf):
    """Texts without a range of months and without an institution."""
    texts = table(spark, sf, "customer").selectExpr("c_custkey AS profile_id", f"{_LOOSE} AS raw_text")
    none = F.lit(None).cast("string")
    jobs = prof.experience_entries(texts, key="profile_id").select("profile_id", "dates", none.alias("degree"), none.alias("gpa"))
    return jobs.unionByName(prof.education_entries(texts, key="profile_id").select("profile_id", none.alias("dates"), "degree", "gpa"))


@query("SELECT doc_id, 'education' AS section_type FROM documents")
def document_education_sections(spark, sf):
    """Whole documents as education sections: however a text runs, its row comes out."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", F.concat(F.lit("EDUCATION "), "text").alias("raw_text"))
    made = docs.select("doc_id", prof.sections_of("raw_text").alias("s"), prof.education_of(F.col("raw_text")).alias("e"))
    return made.filter("size(e) >= 0").select("doc_id", F.col("s")[0]["section_type"].alias("section_type"))


@query(f"""
SELECT c_custkey AS profile_id, {v.PROJECT_NAME} AS name, 'Java, ' || {v.TECH2} AS technologies, {v.PROJECT_BULLET} AS bullets
FROM customer
""")
def project_entries(spark, sf):
    rows = prof.project_entries(profile_texts(spark, sf), key="profile_id")
    return rows.select("profile_id", "name", F.array_join("technologies", ", ").alias("technologies"),
                       F.array_join("description", "; ").alias("bullets"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' has led the ' || lower(c_mktsegment) || ' desk for ' || c_nationkey || ' long years' END AS summary
FROM customer
""")
def extract_summaries(spark, sf):
    """Even customers have a long summary, the others one that is too short to keep."""
    texts = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN 'About me: ' || c_name || ' has led the ' || lower(c_mktsegment) || "
        "' desk for ' || CAST(c_nationkey AS STRING) || ' long years EDUCATION none' ELSE 'Summary: short EDUCATION' END AS raw_text")
    return prof.extract_summaries(texts).select("c_custkey", "summary")


@query(f"""
SELECT c_custkey AS profile_id, c_name AS full_name, {v.EMAIL} AS email, {v.FOUND_LOCATION} AS location, {v.FOUND_SKILLS} AS skills,
       2::BIGINT AS jobs, 1::BIGINT AS schools, 1::BIGINT AS projects, 'email,phone,linkedin,skills,projects' AS by_regex,
       CASE WHEN c_custkey % 3 < 2 THEN 'name,location,experience,education' ELSE 'name,experience,education' END AS by_other
FROM customer
""")
def build_profiles(spark, sf):
    size = lambda c: F.size(c).cast("bigint")
    return profiles(spark, sf).select(
        "profile_id", "full_name", "email", "location", F.array_join("skills", ", ").alias("skills"),
        size("experience").alias("jobs"), size("education").alias("schools"), size("projects").alias("projects"),
        F.array_join("extraction_methods.regex", ",").alias("by_regex"),
        F.array_join("extraction_methods.pattern", ",").alias("by_other"))


# --- corrections and rewrites ------------------------------------------------------------------------------------


@query(f"""
SELECT c_custkey AS profile_id, 'Name ' || c_custkey AS full_name,
       CASE WHEN c_custkey % 2 = 1 THEN {v.EMAIL} END AS email,
       CASE WHEN c_custkey % 3 = 0 THEN 'a, b' ELSE {v.FOUND_SKILLS} END AS skills,
       CASE WHEN c_custkey % 3 = 0 THEN 'Acme: did this / did that' ELSE {v.COMPANY1} || ': ' || {v.BULLET1} || ' / ' || {v.FOUND_BULLET2} END AS job
FROM customer
""")
def overlay_corrections(spark, sf):
    """Pass 1 renames everybody and clears the address of even customers; pass 2 replaces the
    lists of every third customer and sends text instead of a list to the others."""
    made = profiles(spark, sf).select("profile_id", "full_name", "email", "phone", "location", "skills", "experience", "education", "projects")
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"))
    first = ids.select("record_id", F.lit(1).alias("pass"), F.concat(
        F.lit('{"full_name": "Name '), F.col("record_id").cast("string"), F.lit('"'),
        F.when(F.col("record_id") % 2 == 0, ', "email": null').otherwise(""), F.lit("}")).alias("json"))
    second = ids.select("record_id", F.lit(2).alias("pass"), F.when(
        F.col("record_id") % 3 == 0,
        F.lit('{"skills": ["a", "b"], "experience": [{"company": "Acme", "title": "T", "bullets": ["did this", "did that"]}]}')
    ).otherwise(F.lit('{"skills": "none", "experience": "none"}')).alias("json"))
    done = prof.overlay_corrections(made, first.unionByName(second), "profile_id")
    job = F.get("experience", F.lit(0))
    return done.select("profile_id", "full_name", "email", F.array_join("skills", ", ").alias("skills"),
                       F.concat(job["company"], F.lit(": "), F.array_join(job["description"], " / ")).alias("job"))


_REWRITES = """
SELECT o_custkey AS profile_id, CASE o_orderkey % 4 WHEN 0 THEN 'experience' WHEN 1 THEN 'project' WHEN 2 THEN 'summary' ELSE 'skills' END AS section_type,
       o_orderkey % 3 AS section_index, o_orderkey FROM orders
"""


def _rewrites(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS profile_id",
        "CASE o_orderkey % 4 WHEN 0 THEN 'experience' WHEN 1 THEN 'project' WHEN 2 THEN 'summary' ELSE 'skills' END AS section_type",
        "CAST(o_orderkey % 3 AS INT) AS section_index", "o_orderkey",
        "'- Order ' || CAST(o_orderkey AS STRING) || '\\n\\n* ' || o_orderpriority || ' ' AS new_text")


@query(f"""
WITH o AS (SELECT o_custkey, o_orderkey % 4 AS kind, o_orderkey % 3 AS i, max(o_orderkey) AS k, arg_max(o_orderpriority, o_orderkey) AS p
           FROM orders GROUP BY ALL),
s AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderkey % 4 = 2 GROUP BY 1)
SELECT c_custkey AS profile_id,
  coalesce('Order ' || a.k || ' / ' || a.p, {v.BULLET1} || ' / ' || {v.FOUND_BULLET2}) AS job_0,
  coalesce('Order ' || b.k || ' / ' || b.p, {v.BULLET3}) AS job_1,
  coalesce('Order ' || d.k || ' / ' || d.p, {v.PROJECT_BULLET}) AS project_0,
  '- Order ' || s.k || chr(10) || chr(10) || '* ' || s.p AS summary
FROM customer
LEFT JOIN o a ON a.o_custkey = c_custkey AND a.kind = 0 AND a.i = 0
LEFT JOIN o b ON b.o_custkey = c_custkey AND b.kind = 0 AND b.i = 1
LEFT JOIN o d ON d.o_custkey = c_custkey AND d.kind = 1 AND d.i = 0
LEFT JOIN s ON s.o_custkey = c_custkey
""")
def apply_rewrites(spark, sf):
    """Every order is a rewrite of a section of its customer's profile; the last one wins."""
    done, _ = prof.apply_rewrites(profiles(spark, sf), _rewrites(spark, sf), "profile_id", "o_orderkey")
    text = lambda c, i: F.array_join(F.get(c, F.lit(i))["description"], " / ")
    return done.select("profile_id", text("experience", 0).alias("job_0"), text("experience", 1).alias("job_1"),
                       text("projects", 0).alias("project_0"), "summary")


@query(f"""
SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN section_type = 'skills' THEN 'unsupported section type'
  WHEN section_type = 'experience' AND section_index >= 2 THEN 'index out of range'
  WHEN section_type = 'project' AND section_index >= 1 THEN 'index out of range' END AS reason FROM ({_REWRITES}))
WHERE reason IS NOT NULL GROUP BY reason
""")
def rewrite_rejects(spark, sf):
    _, rejected = prof.apply_rewrites(profiles(spark, sf), _rewrites(spark, sf), "profile_id", "o_orderkey")
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
