"""Postings and profiles derived from the given tables.

Texts are put together from columns by SQL expressions that Spark and DuckDB both read, so a
query can parse a text while its SQL says from the columns what the parts must be. Every row of
a table becomes a text; the texts grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profiles import build_profiles, clean_profile
from ..session import apply_settings
from ..sources.tables import read_table

# --- one profile text per customer -----------------------------------------------------------------

K = "c_custkey"
EMAIL = "lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@example.com'"
PHONE = ("'(' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || ') 555-' || "
         "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')")
LINKEDIN = "'linkedin.com/in/user' || CAST(c_custkey AS STRING)"
CITY = "CASE c_custkey % 3 WHEN 0 THEN 'Portland, OR' WHEN 1 THEN 'San Diego, CA' ELSE 'Boston, MA' END"
COMPANY1 = ("CASE c_mktsegment WHEN 'BUILDING' THEN 'Brick Works' WHEN 'MACHINERY' THEN 'Gear Partners' "
            "WHEN 'FURNITURE' THEN 'Oak and Sons' WHEN 'HOUSEHOLD' THEN 'Home Goods' ELSE 'Road Motors' END")
TITLE1 = "CASE c_custkey % 4 WHEN 0 THEN 'Senior Software Engineer' WHEN 1 THEN 'Data Analyst' WHEN 2 THEN 'Cloud Architect' ELSE 'Junior Developer' END"
DATES1 = "'Jan ' || CAST(2010 + c_custkey % 10 AS STRING) || ' - Present'"
DATES2 = "'March ' || CAST(2000 + c_nationkey % 10 AS STRING) || ' – Dec ' || CAST(2001 + c_nationkey % 10 AS STRING)"
BULLET1 = "'Built a pipeline for nation ' || CAST(c_nationkey AS STRING) || ' orders'"
BULLET2 = "'Reduced costs by ' || CAST(c_custkey % 90 AS STRING) || '%'"
COMPANY2, TITLE2 = "'Northwind Traders'", "'Database Administrator'"
BULLET3 = "'Kept ' || CAST(c_custkey % 50 AS STRING) || ' servers running at night'"
JOB1 = f"{COMPANY1} || ', Portland, OR ' || {TITLE1} || ' ' || {DATES1}"
JOB2 = f"{COMPANY2} || ', Austin, TX ' || {TITLE2} || ' ' || {DATES2}"
EXPERIENCE = f"{JOB1} || ' • ' || {BULLET1} || ' • ' || {BULLET2} || ' ' || {JOB2} || ' • ' || {BULLET3}"
SCHOOL = "CASE c_nationkey % 3 WHEN 0 THEN 'Oregon State University' WHEN 1 THEN 'Boston College' ELSE 'Purdue University' END"
EDU_DATE = "'June ' || CAST(1990 + c_custkey % 20 AS STRING)"
GPA = "'3.' || CAST(c_custkey % 10 AS STRING)"
EDUCATION = f"{SCHOOL} || ' Bachelor of Science in Computer Science, ' || {EDU_DATE} || ' GPA: ' || {GPA}"
SKILLS = ("CASE c_custkey % 5 WHEN 0 THEN 'Python, SQL, Docker, machine learning' WHEN 1 THEN 'Java, Spring, K8s, problem solving' "
          "WHEN 2 THEN 'C++, node.js, React Native, communication' WHEN 3 THEN 'scikit-learn, pandas, Spark, project management' "
          "ELSE 'ASP.NET, .NET, C#, teamwork' END")
PROJECT_NAME = "'Route Finder'"
TECH2 = "CASE c_custkey % 2 WHEN 0 THEN 'React' ELSE 'Kotlin' END"
PROJECT_BULLET = "'Created a route service for ' || CAST(c_custkey AS STRING) || ' users'"
PROJECT = f"{PROJECT_NAME} || ' (Java | ' || {TECH2} || '): • ' || {PROJECT_BULLET}"
HEAD = f"c_name || ' ' || {EMAIL} || ' ' || {PHONE} || ' ' || {LINKEDIN} || ' ' || {CITY}"
PROFILE_TEXT = (f"{HEAD} || ' WORK EXPERIENCE ' || {EXPERIENCE} || ' EDUCATION ' || {EDUCATION} || "
                f"' TECHNICAL SKILLS ' || {SKILLS} || ' PERSONAL PROJECTS ' || {PROJECT}")

# What parsing must find.
FOUND_LOCATION = "CASE c_custkey % 3 WHEN 0 THEN 'Portland, OR' WHEN 1 THEN 'San Diego, CA' END"
# Bullets end at the next bullet, so the last one runs into the heading of the next entry.
FOUND_BULLET2 = f"{BULLET2} || ' ' || {COMPANY2} || ', Austin, TX ' || {TITLE2}"
_SECTION_SKILLS = ("CASE c_custkey % 5 WHEN 0 THEN 'docker, java, machine learning, python, sql' "
                   "WHEN 1 THEN 'java, kubernetes, problem solving, spring' "
                   "WHEN 2 THEN 'c++, communication, java, node, react' "
                   "WHEN 3 THEN 'java, pandas, project management, scikit-learn, spark' "
                   "ELSE '.net, asp.net, c#, java, teamwork' END")
FOUND_SKILLS = (f"array_to_string(list_sort(list_distinct(list_append(string_split({_SECTION_SKILLS}, ', '), lower({TECH2})))), ', ')")

# --- one posting text per part ---------------------------------------------------------------------------

POSTING_TITLE = "CASE p_size % 4 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Backend Developer' WHEN 2 THEN 'Cloud Architect' ELSE 'Database Administrator' END"
POSTING_PLACE = "CASE p_size % 3 WHEN 0 THEN 'Austin, TX' WHEN 1 THEN 'Remote' ELSE 'New York, NY' END"
POSTING_SKILLS = ("CASE p_size % 6 WHEN 0 THEN 'Python, SQL and machine learning' WHEN 1 THEN 'Java, Spring and Kubernetes' "
                  "WHEN 2 THEN 'c++, React and good communication' WHEN 3 THEN 'Spark, sklearn and project management' "
                  "WHEN 4 THEN 'C# on .NET, teamwork' ELSE 'patience' END")
POSTING_TEXT = (
    f"'Job Title: ' || {POSTING_TITLE} || chr(10) || 'Company: ' || p_brand || chr(10) || chr(10) || chr(10) || "
    f"'Location: ' || {POSTING_PLACE} || chr(10) || 'We make every  ' || p_name || ' in the ' || p_type || ' line. You bring ' || "
    f"{POSTING_SKILLS} || '.' || chr(10) || "
    "CASE p_size % 2 WHEN 0 THEN 'A bachelor degree helps. ' ELSE '' END || "
    "'Former people of Brick Works and Northwind Traders do well here.' || chr(10) || "
    "'Apply here: https://jobs.example.com/' || CAST(p_partkey AS STRING) || chr(10) || "
    "CASE p_size % 5 WHEN 0 THEN 'Equal Opportunity Employer. All qualified applicants are welcome.' "
    "WHEN 1 THEN 'We are an equal opportunity workplace. E-Verify is used.' ELSE 'See you soon.' END")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(apply_settings(spark), folder, name)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy work on a table that arrives in fewer partitions than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def profile_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(profile_id, full_name, raw_text), one row per customer."""
    texts = spread(table(spark, folder, "customer")).selectExpr(
        "c_custkey AS profile_id", "c_name AS full_name", f"{PROFILE_TEXT} AS raw_text")
    return texts.withColumn("raw_text", clean_profile("raw_text"))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles parsed from the texts."""
    return build_profiles(profile_texts(spark, folder), names="full_name")


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """(posting_id, description, source), one row per part."""
    return spread(table(spark, folder, "part")).selectExpr(
        "p_partkey AS posting_id", f"{POSTING_TEXT} AS description", "p_brand AS source")


def bought(spark: SparkSession, folder: str) -> DataFrame:
    """(posting_id, profile_id): distinct pairs of a part and a customer that ordered it."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("posting_id"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("profile_id"))
    return lines.join(orders, "l_orderkey").select("posting_id", "profile_id").distinct()


PAIRS_SQL = "SELECT DISTINCT l_partkey AS posting_id, o_custkey AS profile_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
POSTINGS_SQL = f"SELECT p_partkey AS posting_id, {POSTING_TEXT} AS description, p_brand AS source, part.* FROM part"
PROFILES_SQL = f"SELECT c_custkey AS profile_id, {PROFILE_TEXT} AS raw_text, customer.* FROM customer"

# --- SQL fragments ------------------------------------------------------------------------------------------

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def sql_words(text: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), "
            "lambda w: regexp_full_match(w, '[a-z]{3,}'))")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
