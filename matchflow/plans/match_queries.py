"""Queries on vectors, semantic matching, rewrites and exports.

Every given vector is a posting vector, and also one section of a profile: five vectors in a row
make a profile with a summary, two jobs, a project and skills.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import export, match, rewrite, sections, skills, vectors
from ..sources.tables import settle
from . import views as v
from .registry import SQL, query
from .views import bought, postings, profile_texts, profiles, spread, sql_text, table

# --- vectors --------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS profile_id, 64::BIGINT AS dims, CASE WHEN c_custkey % 10 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length FROM customer")
def vectorise_profiles(spark, sf):
    """Every tenth text is blank and must give the zero vector."""
    texts = profile_texts(spark, sf).withColumn("raw_text", F.when(F.col("profile_id") % 10 != 0, F.col("raw_text")).otherwise(" "))
    made = vectors.vectorise(texts, "raw_text", vectors.fit_encoder(texts, "raw_text", 64), dims=64)
    return made.select("profile_id", F.size("embedding").cast("bigint").alias("dims"),
                       F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 5).alias("length"))


@query("""
SELECT conv_id AS profile_id, role AS section_type, CAST(turn AS BIGINT) AS section_index, md5(text) AS content_hash,
       CASE WHEN role = 'user' THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS created, length(text)::DOUBLE AS head
FROM conversations
""")
def refresh_vectors(spark, sf):
    """The stored vectors of the assistant's turns are out of date and some sections are gone."""
    turns = table(spark, sf, "conversations")
    rows = turns.select(F.col("conv_id").alias("profile_id"), F.col("role").alias("section_type"),
                        F.col("turn").cast("int").alias("section_index"), F.col("text").alias("content"),
                        F.md5("text").alias("content_hash"))
    encode = lambda df: df.withColumn("embedding", F.array(F.length("content").cast("float")))
    old = encode(rows).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    changed = F.when(F.col("section_type") == "user", F.col("content_hash")).otherwise(F.md5(F.concat("content", F.lit("x"))))
    stale = old.withColumn("section_index", F.col("section_index") + 1000)
    store = old.withColumn("content_hash", changed).unionByName(stale).drop("content")
    fresh = vectors.refresh_vectors(rows, store, encode, F.lit("2024-02-01").cast("timestamp"))
    return fresh.select("profile_id", "section_type", F.col("section_index").cast("bigint").alias("section_index"), "content_hash",
                        F.to_date("created_at").alias("created"), F.get("embedding", F.lit(0)).cast("double").alias("head"))


def _posting_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("posting_id"), "embedding")


def _section_vectors(spark, sf):
    place = F.col("vec_id") % 5
    kind = F.when(place == 0, "summary").when(place < 3, "experience").when(place == 3, "project").otherwise("skills")
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 5).alias("profile_id"), kind.alias("section_type"),
        F.when(place == 2, 1).otherwise(0).alias("section_index"), "embedding")


def _profile_vectors(spark, sf):
    return _section_vectors(spark, sf).groupBy("profile_id").agg(
        F.max(F.when(F.col("section_type") == "summary", F.col("embedding"))).alias("embedding"))


_SIM = "round(list_cosine_similarity({}.embedding::DOUBLE[], {}.embedding::DOUBLE[]), 6)"
_SECTIONS = """
SELECT CAST(floor(vec_id / 5) AS BIGINT) AS profile_id,
  CASE vec_id % 5 WHEN 0 THEN 'summary' WHEN 1 THEN 'experience' WHEN 2 THEN 'experience' WHEN 3 THEN 'project' ELSE 'skills' END AS section_type,
  CASE vec_id % 5 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS section_index, embedding FROM embeddings
"""
MATCH = f"""
WITH sections AS ({_SECTIONS}),
sims AS (SELECT a.vec_id AS posting_id, b.profile_id, {_SIM.format('a', 'b')} AS similarity
         FROM embeddings a, sections b WHERE b.section_type = 'summary'),
candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY similarity DESC, profile_id) AS r FROM sims) WHERE r <= 10),
scores AS (SELECT posting_id, c.profile_id, section_type, section_index,
           round(list_dot_product(e.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) AS score
           FROM candidates c JOIN embeddings e ON e.vec_id = c.posting_id JOIN sections s ON s.profile_id = c.profile_id),
kinds AS (SELECT posting_id, profile_id, section_type, avg(score) AS score FROM scores GROUP BY ALL),
weighted AS (SELECT *, CASE section_type WHEN 'summary' THEN 0.15::DOUBLE WHEN 'experience' THEN 0.40::DOUBLE WHEN 'project' THEN 0.25::DOUBLE ELSE 0.20::DOUBLE END AS w FROM kinds),
overall AS (SELECT posting_id, profile_id, round(sum(score * w) / sum(w), 9) AS overall_score FROM weighted GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY overall_score DESC, profile_id) AS rank FROM overall) WHERE rank <= 5)
"""


@query(f"""
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine_pairs(spark, sf):
    rows = table(spark, sf, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    scored = vectors.cosine_pairs(rows.select("vec_id", "embedding").join(after, "vec_id"), "embedding", "other")
    return scored.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""
SELECT posting_id, profile_id, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY similarity DESC, profile_id) AS r FROM (
    SELECT a.vec_id AS posting_id, b.vec_id AS profile_id, {_SIM.format('a', 'b')} AS similarity FROM embeddings a, embeddings b))
WHERE r <= 10
""")
def topk_cosine(spark, sf):
    """The ten nearest vectors of every vector."""
    stored = _posting_vectors(spark, sf).withColumnRenamed("posting_id", "profile_id")
    return match.top_candidates(_posting_vectors(spark, sf), stored, 10)


@query(SQL["topk_cosine"])
def topk_cosine_blocks(spark, sf):
    """The same over several cells and blocks."""
    stored = _posting_vectors(spark, sf).withColumnRenamed("posting_id", "profile_id")
    return match.top_candidates(_posting_vectors(spark, sf), stored, 10, block_rows=128)


@query(f"""
SELECT a.vec_id, least(a.vec_id, coalesce(min(b.vec_id), a.vec_id)) AS keeper
FROM embeddings a LEFT JOIN embeddings b ON {_SIM.format('a', 'b')} >= 0.4 GROUP BY a.vec_id
""")
def near_dups(spark, sf):
    return vectors.near_dups(table(spark, sf, "embeddings").select("vec_id", "embedding"), 0.4)


@query(SQL["near_dups"])
def near_dups_blocks(spark, sf):
    """The same over several cells and blocks."""
    return vectors.near_dups(table(spark, sf, "embeddings").select("vec_id", "embedding"), 0.4, block_rows=128)


@query("""
SELECT doc_id AS posting_id, c_custkey AS profile_id, 0.0::DOUBLE AS similarity
FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
     (SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY max(o_orderdate) DESC, c_custkey LIMIT 10)
""")
def fallback_candidates(spark, sf):
    """Documents without a label stand for postings without candidates."""
    wanted = table(spark, sf, "documents").select(F.col("doc_id").alias("posting_id"))
    have = table(spark, sf, "labels").select(F.col("doc_id").alias("posting_id"))
    people = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("profile_id")).agg(F.max("o_orderdate").alias("created_at"))
    return match.fallback_candidates(wanted, have, people, 10)


# --- scores ----------------------------------------------------------------------------------------------------


def _scores(spark, sf):
    candidates = match.top_candidates(_posting_vectors(spark, sf), _profile_vectors(spark, sf), 10)
    return match.score_sections(candidates, _section_vectors(spark, sf), _posting_vectors(spark, sf))


@query(MATCH + "SELECT * FROM scores")
def section_scores(spark, sf):
    return _scores(spark, sf).withColumn("section_index", F.col("section_index").cast("bigint"))


@query(MATCH + "SELECT * FROM overall")
def overall_scores(spark, sf):
    return match.overall_score(_scores(spark, sf))


@query(MATCH + """
SELECT *, row_number() OVER (PARTITION BY posting_id, profile_id ORDER BY score, section_type, section_index) AS place
FROM scores WHERE score < 0.1
""")
def weak_sections(spark, sf):
    rows = match.weak_sections(_scores(spark, sf), 0.1)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("section_index", "place")})


@query(MATCH + """
SELECT posting_id, profile_id, count(*) AS n, max(score) FILTER (WHERE section_type = 'summary') AS summary,
       max(score) FILTER (WHERE section_type = 'experience' AND section_index = 1) AS second_job
FROM scores GROUP BY ALL
""")
def score_map(spark, sf):
    rows = match.score_map(_scores(spark, sf))
    return rows.select("posting_id", "profile_id", F.size("scores").cast("bigint").alias("n"),
                       F.col("scores")["summary"].alias("summary"), F.col("scores")["experience_1"].alias("second_job"))


@query(MATCH + "SELECT * FROM best")
def leaderboard(spark, sf):
    """Flagship: for every posting the best five of the ten nearest profiles."""
    best = match.leaderboard(_posting_vectors(spark, sf), _profile_vectors(spark, sf), _section_vectors(spark, sf), 5)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""
WITH sections AS ({_SECTIONS}),
kinds AS (SELECT a.vec_id AS posting_id, s.profile_id, section_type, avg(round(list_dot_product(a.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6)) AS score
          FROM embeddings a JOIN sections s ON s.profile_id = a.label GROUP BY ALL),
weighted AS (SELECT *, CASE section_type WHEN 'summary' THEN 0.15::DOUBLE WHEN 'experience' THEN 0.40::DOUBLE WHEN 'project' THEN 0.25::DOUBLE ELSE 0.20::DOUBLE END AS w FROM kinds)
SELECT posting_id, profile_id, round(sum(score * w) / sum(w), 9) AS overall_score FROM weighted GROUP BY ALL
""")
def score_pairs(spark, sf):
    """Given pairs: every posting with the profile its label names."""
    pairs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("posting_id"), F.col("label").cast("bigint").alias("profile_id"))
    return match.score_pairs(pairs, _section_vectors(spark, sf), _posting_vectors(spark, sf))


_SHARE = "CASE section_type " + " ".join(
    f"WHEN '{kind}' THEN {fixed.SECTION_WEIGHTS[kind]}::DOUBLE + CASE WHEN profile_id % 3 = 0 THEN {fixed.SECTION_WEIGHTS['summary'] * fixed.SUMMARY_SHARES.get(kind, 0.0)}::DOUBLE ELSE 0 END"
    for kind in fixed.SECTION_WEIGHTS) + " END"


@query(f"""
WITH sections AS (SELECT * FROM ({_SECTIONS}) WHERE NOT (section_type = 'summary' AND profile_id % 3 = 0)),
kinds AS (SELECT a.vec_id AS posting_id, s.profile_id, section_type, avg(round(list_dot_product(a.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6)) AS score
          FROM embeddings a JOIN sections s ON s.profile_id = a.label GROUP BY ALL),
weighted AS (SELECT *, {_SHARE} AS w FROM kinds)
SELECT posting_id, profile_id, round(round(sum(score * w) / sum(w), 9) + 1e-10, 6) AS overall_score FROM weighted GROUP BY ALL
""")
def score_pairs_without_summary(spark, sf):
    """The same where a third of the profiles have no summary, whose weight goes to their other sections.

    Means of two scores lie half way between two last digits; the small addition sends both engines up.
    """
    pairs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("posting_id"), F.col("label").cast("bigint").alias("profile_id"))
    sections = _section_vectors(spark, sf).filter("NOT (section_type = 'summary' AND profile_id % 3 = 0)")
    return match.score_pairs(pairs, sections, _posting_vectors(spark, sf)).withColumn("overall_score", F.round(F.col("overall_score") + 1e-10, 6))


@query(MATCH + "SELECT profile_id, count(*) AS uses FROM best WHERE rank = 1 AND overall_score >= 0.2 GROUP BY 1")
def route_uses(spark, sf):
    best = match.leaderboard(_posting_vectors(spark, sf), _profile_vectors(spark, sf), _section_vectors(spark, sf), 5)
    return match.route(best, 0.2)[1]


# --- section texts ------------------------------------------------------------------------------------------------

_SUMMARY = "'Leads ' || lower(c_mktsegment) || ' work & more'"
_JOB1 = f"{v.TITLE1} || ' ' || {v.COMPANY1} || ' ' || {v.DATES1} || ' ' || {v.BULLET1} || ' ' || {v.FOUND_BULLET2}"
_JOB2 = f"'Administrator ' || {v.COMPANY2} || ' ' || {v.DATES2} || ' ' || {v.BULLET3}"
_WORK = f"{v.PROJECT_NAME} || ' Java, ' || {v.TECH2} || ' ' || {v.PROJECT_BULLET}"
_PARTS = (("summary", 0, _SUMMARY), ("experience", 0, _JOB1), ("experience", 1, _JOB2), ("project", 0, _WORK), ("skills", 0, v.FOUND_SKILLS))
_TEXTS = " UNION ALL ".join(
    f"SELECT c_custkey AS profile_id, '{kind}' AS section_type, {i}::BIGINT AS section_index, {text} AS content FROM customer"
    for kind, i, text in _PARTS)


def _summarised(spark, sf):
    segment = table(spark, sf, "customer").selectExpr("c_custkey AS profile_id", f"{_SUMMARY} AS summary")
    return profiles(spark, sf).drop("summary").join(segment, "profile_id")


@query(f"SELECT *, md5(content) AS content_hash FROM ({_TEXTS})")
def section_rows(spark, sf):
    return match.section_rows(_summarised(spark, sf)).withColumn("section_index", F.col("section_index").cast("bigint"))


@query(f"""
SELECT c_custkey AS profile_id, c_name || ' ' || {_SUMMARY} || ' ' || {v.FOUND_SKILLS} || ' ' || {_JOB1} || ' ' || {_JOB2} || ' ' || {_WORK} ||
       ' Bachelor of Science ' || {v.SCHOOL} || ' Computer Science ' || {v.EDU_DATE} AS text
FROM customer
""")
def full_text(spark, sf):
    return match.full_text(_summarised(spark, sf))


@query(f"""
SELECT c_custkey AS profile_id, upper(c_name) || chr(10) || {v.EMAIL} || ' |  ' || {v.PHONE} || CASE WHEN c_custkey % 3 < 2 THEN ' | ' || {v.FOUND_LOCATION} ELSE '' END
  || chr(10) || chr(10) || 'SUMMARY' || chr(10) || {_SUMMARY} || chr(10) || chr(10)
  || 'EXPERIENCE' || chr(10) || {v.TITLE1} || ' - ' || {v.COMPANY1} || chr(10) || {v.DATES1} || chr(10) || '  - ' || {v.BULLET1} || chr(10) || '  - ' || {v.FOUND_BULLET2}
  || chr(10) || chr(10) || 'Administrator - ' || {v.COMPANY2} || chr(10) || {v.DATES2} || chr(10) || '  - ' || {v.BULLET3} || chr(10) || chr(10)
  || 'PROJECTS' || chr(10) || {v.PROJECT_NAME} || chr(10) || 'Technologies: Java, ' || {v.TECH2} || chr(10) || '  - ' || {v.PROJECT_BULLET} || chr(10) || chr(10)
  || 'SKILLS' || chr(10) || {v.FOUND_SKILLS} || chr(10) || chr(10)
  || 'EDUCATION' || chr(10) || 'Bachelor of Science - ' || {v.SCHOOL} || chr(10) || {v.EDU_DATE} || chr(10) AS text
FROM customer
""")
def export_text(spark, sf):
    return export.export_text(_summarised(spark, sf))


# One weak section per ordered part: its kind comes from the line number, its score from the discounts.
_WEAK = """
SELECT l_partkey AS posting_id, o_custkey AS profile_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'experience' WHEN 1 THEN 'project' WHEN 2 THEN 'summary' ELSE 'skills' END AS section_type,
  0 AS section_index, max(l_discount * 10) AS score, max(l_returnflag) AS flag
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
"""


def _weak(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_returnflag")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    kind = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'experience' WHEN 1 THEN 'project' WHEN 2 THEN 'summary' ELSE 'skills' END")
    return lines.join(orders, "l_orderkey").groupBy(
        F.col("l_partkey").alias("posting_id"), F.col("o_custkey").alias("profile_id"), kind.alias("section_type")
    ).agg(F.max(F.col("l_discount") * 10).alias("score"), F.max("l_returnflag").alias("flag")).withColumn("section_index", F.lit(0))


_ESCAPED = "replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""
SELECT posting_id, profile_id, section_type, {_ESCAPED} AS html,
  CASE WHEN score < 0.5 THEN 'weak-section' WHEN score >= 0.7 THEN 'strong-section' ELSE 'moderate-section' END AS style,
  CASE WHEN score <> 0 THEN CAST(CAST(round(score * 100) AS BIGINT) AS VARCHAR) || '%' END AS badge,
  CASE WHEN score <> 0 AND section_type IN ('experience', 'project') THEN
    CASE WHEN score < 0.5 THEN 'weak' WHEN score < 0.7 THEN 'moderate' ELSE 'strong' END END AS badge_style
FROM ({_WEAK}) w JOIN ({_TEXTS}) t USING (profile_id, section_type, section_index)
""")
def annotated_sections(spark, sf):
    rows = export.annotated_sections(_summarised(spark, sf), _weak(spark, sf).drop("flag"))
    return rows.drop("section_index")


@query(f"""
WITH x AS (SELECT p.posting_id, p.profile_id, unnest(string_split(s.skills, ', ')) AS skill, unnest(range(len(string_split(s.skills, ', ')))) AS position,
                  CASE p.posting_id % 2 WHEN 0 THEN ['java', 'sql'] ELSE ['docker', 'c++'] END AS matched
           FROM ({v.PAIRS_SQL}) p JOIN (SELECT c_custkey AS profile_id, {v.FOUND_SKILLS} AS skills FROM customer) s USING (profile_id))
SELECT posting_id, profile_id, position::BIGINT AS position, skill, list_contains(matched, skill) AS matched FROM x
""")
def annotated_skills(spark, sf):
    own = profile_texts(spark, sf).select("profile_id", skills.skill_list("raw_text").alias("skills"))
    gaps = bought(spark, sf).withColumn("matched", F.when(
        F.col("posting_id") % 2 == 0, F.array(F.lit("Java"), F.lit("sql "))).otherwise(F.array(F.lit("docker"), F.lit("C++"))))
    return export.annotated_skills(own, gaps).withColumn("position", F.col("position").cast("bigint"))


# --- rewrites -------------------------------------------------------------------------------------------------------

_KEY_TEXTS = " UNION ALL ".join(f"SELECT c_custkey AS profile_id, '{kind}' AS section_type, {text} AS content FROM customer" for kind, text in (
    ("experience", f"{v.TITLE1} || '|' || {v.COMPANY1} || '|' || {v.BULLET1} || chr(10) || {v.FOUND_BULLET2}"),
    ("project", f"{v.PROJECT_NAME} || '|Java,' || {v.TECH2} || '|' || {v.PROJECT_BULLET}"),
    ("summary", _SUMMARY)))
_LEADS = "CASE section_type WHEN 'experience' THEN format({}, {}) WHEN 'project' THEN format({}, {}) ELSE format({}, {}) END".format(*(
    x for kind, parts in (
        ("experience", (v.TITLE1, v.COMPANY1, v.DATES1, f"'- ' || {v.BULLET1} || chr(10) || '- ' || {v.FOUND_BULLET2}")),
        ("project", (v.PROJECT_NAME, f"'Java, ' || {v.TECH2}", f"'- ' || {v.PROJECT_BULLET}")), ("summary", (_SUMMARY,)))
    for x in (sql_text(rewrite.LEADS[kind].replace("%s", "{}")), ", ".join(parts))))
_TAILS = "CASE section_type " + " ".join(f"WHEN '{kind}' THEN {sql_text(text)}" for kind, text in rewrite.TAILS.items()) + " END"
_ASKED = f"""
WITH asked AS (SELECT w.*, md5(content || '|||' || description) AS cache_key,
                      {_LEADS} || description || {_TAILS} AS prompt
               FROM (SELECT * FROM customer) c JOIN ({_WEAK}) w ON c_custkey = w.profile_id JOIN ({_KEY_TEXTS}) k USING (profile_id, section_type)
               JOIN ({v.POSTINGS_SQL}) p USING (posting_id)),
cache AS (SELECT cache_key, 'answer ' || cache_key AS response_text FROM asked WHERE flag = 'R' GROUP BY cache_key)
"""


def _worklist(spark, sf):
    """The cache holds the answers for returned parts."""
    weak, requests, texts = settle(_weak(spark, sf)), rewrite.section_requests(_summarised(spark, sf)), postings(spark, sf)
    returned = weak.filter("flag = 'R'").join(requests, ["profile_id", "section_type", "section_index"]).join(texts, "posting_id")
    cache = returned.filter("section_type <> 'skills'").select(rewrite.cache_key("content", "description").alias("cache_key")).distinct()
    cache = cache.withColumn("response_text", F.concat(F.lit("answer "), "cache_key"))
    return rewrite.rewrite_worklist(weak, requests, texts, cache)


@query(_ASKED + "SELECT posting_id, profile_id, section_type, cache_key, response_text FROM asked JOIN cache USING (cache_key)")
def rewrite_hits(spark, sf):
    return _worklist(spark, sf)[0].drop("section_index")


@query(_ASKED + "SELECT cache_key, count(*) AS sections, arg_min(prompt, (posting_id, profile_id, section_type)) AS prompt FROM asked WHERE cache_key NOT IN (SELECT cache_key FROM cache) GROUP BY cache_key")
def rewrite_todo(spark, sf):
    return _worklist(spark, sf)[1]


@query(f"SELECT posting_id, profile_id, {sql_text(fixed.UNSUPPORTED)} AS reason FROM ({_WEAK}) WHERE section_type = 'skills'")
def rewrite_unsupported(spark, sf):
    return _worklist(spark, sf)[2].select("posting_id", "profile_id", "reason")


_CACHE = "SELECT user_id || '|' || event_type AS cache_key, max(ts) AS created_at FROM events GROUP BY 1"


def _cache(spark, sf):
    events = table(spark, sf, "events")
    cache = events.groupBy(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("cache_key")).agg(
        F.max("ts").alias("created_at"))
    newest = events.agg(F.max("ts").alias("ts")).first()["ts"]
    return cache, F.lit(newest).cast("timestamp_ntz")


@query(f"SELECT cache_key FROM ({_CACHE}) WHERE created_at >= (SELECT max(ts) FROM events) - INTERVAL 3 DAYS")
def cache_expiry(spark, sf):
    cache, now = _cache(spark, sf)
    return rewrite.expire_cache(cache, 3, now)[0].select("cache_key")


@query(f"SELECT count(*) AS deleted FROM ({_CACHE}) WHERE created_at < (SELECT max(ts) FROM events) - INTERVAL 3 DAYS")
def cache_expired(spark, sf):
    cache, now = _cache(spark, sf)
    return rewrite.expire_cache(cache, 3, now)[1]


@query(f"""
SELECT count(*) AS total_entries, count(*) FILTER (WHERE created_at > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS) AS recent_entries FROM ({_CACHE})
""")
def cache_stats(spark, sf):
    cache, now = _cache(spark, sf)
    return rewrite.cache_stats(cache, now)


# --- section to section -----------------------------------------------------------------------------------

PARTNERS = {"duties": ["experience", "project"], "requirements": ["skills"]}
#: Four vectors in a row make the sections of a posting; its first stands for it in the search for candidates.
_PAIRED = f"""
WITH theirs AS ({_SECTIONS}),
ours AS (SELECT CAST(floor(vec_id / 4) AS BIGINT) AS posting_id, CASE vec_id % 4 WHEN 0 THEN 'summary' WHEN 3 THEN 'requirements' ELSE 'duties' END AS posting_type,
         CASE vec_id % 4 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS posting_index, embedding FROM embeddings),
sims AS (SELECT a.posting_id, b.profile_id, {_SIM.format('a', 'b')} AS similarity FROM ours a, theirs b WHERE a.posting_type = 'summary' AND b.section_type = 'summary'),
pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY similarity DESC, profile_id) AS r FROM sims) WHERE r <= 10),
met AS (SELECT posting_id, profile_id, posting_type, posting_index, section_type, section_index,
        round(list_dot_product(o.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS score
        FROM pairs JOIN ours o USING (posting_id) JOIN theirs t USING (profile_id))
"""


def _met_sections(spark, sf, partners=None, one_to_one=False):
    place = F.col("vec_id") % 4
    kind = F.when(place == 0, "summary").when(place == 3, "requirements").otherwise("duties")
    ours = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("posting_id"), kind.alias("section_type"), F.when(place == 2, 1).otherwise(0).alias("section_index"), "embedding")
    theirs = _section_vectors(spark, sf)
    summaries = lambda df, key: df.where("section_type = 'summary'").select(key, "embedding")
    pairs = match.top_candidates(summaries(ours, "posting_id"), summaries(theirs, "profile_id"), 10)
    return sections.section_links(pairs, ours, theirs, partners, one_to_one)


@query(_PAIRED + """
SELECT posting_id, profile_id, posting_type, posting_index, section_type, section_index, score FROM (
  SELECT *, row_number() OVER (PARTITION BY posting_id, profile_id, posting_type, posting_index ORDER BY score DESC, section_type, section_index) AS r
  FROM met WHERE posting_type = 'summary' OR (posting_type = 'duties' AND section_type IN ('experience', 'project')) OR (posting_type = 'requirements' AND section_type = 'skills'))
WHERE r = 1
""")
def section_partners(spark, sf):
    """Duties meet jobs and projects, requirements meet skills, the summary meets all."""
    return _met_sections(spark, sf, PARTNERS).where("score IS NOT NULL")


@query(_PAIRED + """
SELECT posting_id, profile_id, count(*) AS sections, count(*) AS partnered, round(sum(score), 6) AS total, round(round(sum(score), 6) / count(*), 9) AS score
FROM (SELECT posting_id, profile_id, posting_type, posting_index, max(score) AS score FROM met GROUP BY ALL) GROUP BY posting_id, profile_id
""")
def section_scores_late(spark, sf):
    return sections.late_interaction(_met_sections(spark, sf))


_SLOT = "(SELECT posting_id, profile_id, section_type || section_index AS other, score FROM met WHERE posting_type = '{}' AND posting_index = {} AND score > 0 UNION ALL SELECT posting_id, profile_id, NULL, 0.0 FROM pairs)"
_APART = " AND ".join(f"coalesce({x}.other <> {y}.other, true)" for i, x in enumerate("abcd") for y in "abcd"[i + 1:])


@query(_PAIRED + f"""
SELECT posting_id, profile_id, round(max(a.score + b.score + c.score + d.score), 6) AS total
FROM {_SLOT.format('summary', 0)} a JOIN {_SLOT.format('duties', 0)} b USING (posting_id, profile_id)
JOIN {_SLOT.format('duties', 1)} c USING (posting_id, profile_id) JOIN {_SLOT.format('requirements', 0)} d USING (posting_id, profile_id)
WHERE {_APART} GROUP BY posting_id, profile_id
""")
def section_assignment(spark, sf):
    """The SQL tries all assignments of four sections."""
    return sections.late_interaction(_met_sections(spark, sf, one_to_one=True)).select("posting_id", "profile_id", "total")
