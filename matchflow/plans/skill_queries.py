"""Queries on skills, keywords and pair analysis.

Postings are the parts, profiles the customers, pairs the parts a customer has ordered.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import analysis, candidates, keywords, match, skills
from . import views as v
from .registry import query
from .views import bought, postings, profile_texts, profiles, spread, sql_list, sql_text, sql_words, table

# --- shared SQL ------------------------------------------------------------------------------------------


def _tax_rows() -> str:
    classes = skills.class_of_spelling()
    rows = []
    for term, kind in skills.DEFAULT_TAXONOMY:
        name = fixed.SKILL_ALIASES.get(term, term) if kind == skills.TECH else term
        normal = fixed.SKILL_ALIASES.get(name, name)
        rows.append(f"({sql_text(term)}, {sql_text(name)}, {sql_text(classes.get(normal, normal))})")
    return ", ".join(rows)


def _tags(key: str, text: str, source: str) -> str:
    """Terms with no word character on either side of one of their places in the text."""
    edge = "NOT regexp_matches({}, '[\\p{{L}}\\p{{N}}_]')"
    sides = f"{edge.format('right(x.pieces[i], 1)')} AND {edge.format('left(x.pieces[i + 1], 1)')}"
    return (f"SELECT DISTINCT {key}, name, cls FROM (SELECT {key}, name, cls, string_split(lower({text}), term) AS pieces "
            f"FROM ({source}), tax WHERE contains(lower({text}), term)) x "
            f"WHERE len(list_filter(range(1, len(x.pieces)), lambda i: {sides})) > 0")


def _ranked(source: str, key: str, text: str, stop) -> str:
    """Rows (key, term, n, first, rank) of the words of each text."""
    return f"""
SELECT {key}, term, count(*) AS n, min(pos) AS first,
       row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, min(pos)) AS rank
FROM (SELECT {key}, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM (
  SELECT {key}, list_filter({sql_words(text)}, lambda w: NOT list_contains({sql_list(stop)}, w)) AS ws FROM ({source})))
GROUP BY {key}, term
"""


def _word_set(text: str) -> str:
    return f"list_distinct(list_filter({sql_words(text)}, lambda w: NOT list_contains({sql_list(fixed.OVERLAP_STOPWORDS)}, w)))"


FEATURES = f"""
WITH tax(term, name, cls) AS (VALUES {_tax_rows()}),
posting AS ({v.POSTINGS_SQL}), profile AS ({v.PROFILES_SQL}), pairs AS ({v.PAIRS_SQL}),
ptags AS (SELECT posting_id, list({{'name': name, 'cls': cls}} ORDER BY name) AS p_tags
          FROM ({_tags('posting_id', 'description', 'SELECT * FROM posting')}) GROUP BY 1),
ftags AS (SELECT profile_id, list(cls) AS f_cls FROM ({_tags('profile_id', 'raw_text', 'SELECT * FROM profile')}) GROUP BY 1),
pterms AS (SELECT posting_id, list(term ORDER BY rank) AS p_terms FROM ({_ranked('SELECT * FROM posting', 'posting_id', 'description', fixed.KEYWORD_STOPWORDS)})
           WHERE rank <= 30 GROUP BY 1),
p AS (SELECT posting_id, lower(description) AS p_text, coalesce(p_tags, []) AS p_tags, p_terms, {_word_set('description')} AS p_words
      FROM posting LEFT JOIN ptags USING (posting_id) LEFT JOIN pterms USING (posting_id)),
f AS (SELECT profile_id, lower(raw_text) AS f_text, f_cls, {_word_set('raw_text')} AS f_words,
        [lower({v.COMPANY1}), lower({v.COMPANY2}), lower({v.TITLE1}), 'administrator'] AS f_names
      FROM profile JOIN ftags USING (profile_id)),
m AS (SELECT posting_id, profile_id, p.*, f.*,
        list_transform(list_filter(p_tags, lambda t: list_contains(f_cls, t.cls)), lambda t: t.name) AS matched,
        list_transform(list_filter(p_tags, lambda t: NOT list_contains(f_cls, t.cls)), lambda t: t.name) AS missing
      FROM pairs JOIN p USING (posting_id) JOIN f USING (profile_id)),
s AS (SELECT m.*, CASE WHEN len(p_tags) = 0 THEN 0.5::DOUBLE ELSE len(matched)::DOUBLE / len(p_tags) END AS coverage,
        len(list_filter(f_names, lambda n: contains(p_text, n)))::DOUBLE / len(f_names) * 20 AS experience_score,
        CASE WHEN {' OR '.join(f"contains(p_text, '{w}')" for w in fixed.DEGREE_WORDS)} THEN 10 ELSE 5 END AS education_score,
        len(list_intersect(p_words, f_words))::DOUBLE / len(p_words) AS overlap,
        (list_filter(p_terms, lambda t: NOT contains(f_text, t)))[1:10] AS keywords
      FROM m),
scored AS (SELECT s.*, round(least(coverage * 60 + experience_score + education_score + overlap * 10, 100.0::DOUBLE), 1) AS match_score FROM s)
"""

# --- skills ----------------------------------------------------------------------------------------------------


@query(f"WITH tax(term, name, cls) AS (VALUES {_tax_rows()}) SELECT posting_id, name AS skill FROM ({_tags('posting_id', 'description', v.POSTINGS_SQL)})")
def skill_tags(spark, sf):
    return skills.tag_skills(postings(spark, sf), key="posting_id", text="description")


@query(f"""
WITH tax AS (SELECT DISTINCT unnest({sql_words('text')}) AS term FROM benchmark)
SELECT DISTINCT doc_id, term AS skill
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents) JOIN tax USING (term)
""")
def skill_tags_derived(spark, sf):
    """Tagging with a vocabulary that grows with the data: all words of the benchmark texts."""
    vocabulary = table(spark, sf, "benchmark").select(F.explode(keywords.words(F.col("text"))).alias("term")).distinct().withColumn("kind", F.lit(skills.SOFT))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return skills.tag_skills(docs, vocabulary)


@query(f"""
WITH alias(a, c) AS (VALUES {', '.join(f"({sql_text(a)}, {sql_text(c)})" for a, c in fixed.SKILL_ALIASES.items())}),
class(t, id) AS (VALUES {', '.join(f"({sql_text(t)}, {sql_text(c)})" for t, c in skills.class_of_spelling().items())}),
x AS (SELECT c_custkey AS profile_id, unnest(string_split({v.SKILLS}, ', ')) AS skill FROM customer)
SELECT profile_id, skill, coalesce(c, lower(skill)) AS canonical, coalesce(id, c, lower(skill)) AS class_id
FROM x LEFT JOIN alias ON a = lower(skill) LEFT JOIN class ON t = coalesce(c, lower(skill))
""")
def normalise_skills(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS profile_id", f"explode(split({v.SKILLS}, ', ')) AS skill")
    return skills.normalise_skills(rows)


@query(FEATURES + """
SELECT posting_id, profile_id, array_to_string(matched, ', ') AS matched, array_to_string(missing, ', ') AS missing, coverage FROM s
""")
def skill_gap(spark, sf):
    have = profile_texts(spark, sf).select("profile_id", skills.skill_list("raw_text").alias("skills"))
    want = postings(spark, sf).select("posting_id", skills.skill_list("description").alias("skills"))
    rows = skills.skill_gap(bought(spark, sf), want, have)
    return rows.select("posting_id", "profile_id", F.array_join("matched", ", ").alias("matched"),
                       F.array_join("missing", ", ").alias("missing"), "coverage")


@query(FEATURES + """,
want AS (SELECT posting_id, p_tags FROM p WHERE len(p_tags) > 0),
shape AS (SELECT DISTINCT p_tags FROM want), cover AS (SELECT DISTINCT f_cls FROM f),
fit AS (SELECT p_tags, f_cls, len(list_filter(p_tags, lambda t: list_contains(f_cls, t.cls)))::BIGINT AS matched FROM shape, cover)
SELECT posting_id, profile_id, matched, matched::DOUBLE / len(p_tags) AS coverage
FROM fit JOIN want USING (p_tags) JOIN f USING (f_cls) WHERE matched >= 1 AND matched::DOUBLE / len(p_tags) >= 0.6
""")
def candidate_pairs(spark, sf):
    """All pairs of a posting and a profile that covers three fifths of its skills."""
    have = profile_texts(spark, sf).select("profile_id", skills.skill_list("raw_text").alias("skills"))
    want = postings(spark, sf).select("posting_id", skills.skill_list("description").alias("skills"))
    return candidates.candidate_pairs(want, have, 0.6)


# --- keywords ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, rank, term, n FROM ({_ranked('documents', 'doc_id', 'text', fixed.KEYWORD_STOPWORDS)}) WHERE rank <= 20"
       .replace("FROM (documents)", "FROM documents"))
def top_terms(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    rows = keywords.top_terms(docs, "doc_id", "text", 20)
    return rows.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "term", F.col("n").cast("bigint").alias("n"))


@query(f"""
WITH t AS ({_ranked('documents', 'doc_id', 'text', fixed.KEYWORD_STOPWORDS)}),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
r AS (SELECT doc_id, term, first, round(n * ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS score FROM t JOIN d USING (term))
SELECT doc_id, rank, term, score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, term) AS rank FROM r) WHERE rank <= 20
""".replace("FROM (documents)", "FROM documents"))
def top_terms_tfidf(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    rows = keywords.top_terms_tfidf(docs, "doc_id", "text", 20)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query(FEATURES + "SELECT posting_id, profile_id, array_to_string(keywords, ', ') AS missing FROM s")
def missing_terms(spark, sf):
    rows = keywords.missing_terms(bought(spark, sf), postings(spark, sf), profile_texts(spark, sf))
    return rows.withColumn("missing", F.array_join("missing", ", "))


@query(FEATURES + "SELECT posting_id, profile_id, overlap FROM s")
def term_overlap(spark, sf):
    return keywords.term_overlap(bought(spark, sf), postings(spark, sf), profile_texts(spark, sf))


@query(f"""
WITH w AS (SELECT doc_id, {_word_set('text')} AS ws FROM documents)
SELECT a.doc_id AS posting_id, b.doc_id AS profile_id,
       CASE WHEN len(a.ws) = 0 THEN 0.5::DOUBLE ELSE len(list_intersect(a.ws, b.ws))::DOUBLE / len(a.ws) END AS overlap
FROM w a JOIN w b ON b.doc_id = a.doc_id + 1
""")
def neighbour_overlap(spark, sf):
    """Every document against the next one, over whole texts."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    pairs = docs.select(F.col("doc_id").alias("posting_id"), (F.col("doc_id") + 1).alias("profile_id"))
    return keywords.term_overlap(pairs, docs.select(F.col("doc_id").alias("posting_id"), F.col("text").alias("description")),
                                 docs.select(F.col("doc_id").alias("profile_id"), F.col("text").alias("raw_text")))


@query(FEATURES + "SELECT posting_id, profile_id, experience_score FROM s")
def experience_overlap(spark, sf):
    return keywords.experience_overlap(bought(spark, sf), postings(spark, sf), profiles(spark, sf).select("profile_id", "experience"))


# --- analysis --------------------------------------------------------------------------------------------------------


@query(FEATURES + """
SELECT posting_id, profile_id, coverage, experience_score, education_score, overlap, match_score FROM scored
""")
def match_scores(spark, sf):
    return analysis.match_scores(bought(spark, sf), postings(spark, sf), profiles(spark, sf))


_QUOTED = "array_to_string(list_transform(missing[1:5], lambda s: '''' || s || ''''), ', ')"
_ADVICE = f"""list_filter([
  CASE WHEN len(missing) = 1 THEN replace({sql_text(fixed.SUGGEST_ONE_SKILL)}, '%s', missing[1])
       WHEN len(missing) > 1 THEN replace({sql_text(fixed.SUGGEST_SKILLS)}, '%s', {_QUOTED}) END,
  {sql_text(fixed.SUGGEST_SUMMARY)}, {sql_text(fixed.SUGGEST_LONGER)},
  CASE WHEN match_score < 50 THEN {sql_text(fixed.SUGGEST_CUSTOMISE)} END], lambda t: t IS NOT NULL)"""


@query(FEATURES + f"SELECT posting_id, profile_id, array_to_string({_ADVICE}, ' # ') AS advice FROM scored")
def suggestions(spark, sf):
    rows = analysis.analyse(bought(spark, sf), postings(spark, sf), profiles(spark, sf))
    return rows.select("posting_id", "profile_id", F.array_join("improvement_suggestions", " # ").alias("advice"))


@query(FEATURES + f"SELECT text, count(*) AS pairs FROM (SELECT unnest({_ADVICE}) AS text FROM scored) GROUP BY text")
def suggestion_counts(spark, sf):
    return analysis.suggestion_counts(analysis.suggestions(bought(spark, sf), postings(spark, sf), profiles(spark, sf)))


@query(FEATURES + f"""
SELECT posting_id, profile_id, match_score, array_to_string(matched, ', ') AS matching_skills, array_to_string(missing, ', ') AS missing_skills,
       array_to_string(keywords, ', ') AS keyword_suggestions, len({_ADVICE})::BIGINT AS n_suggestions,
       len(p_tags)::BIGINT AS posting_skills, len(f_cls)::BIGINT AS profile_skills, len(keywords)::BIGINT AS missing_keywords
FROM scored
""")
def analyse_pairs(spark, sf):
    rows = analysis.analyse(bought(spark, sf), postings(spark, sf), profiles(spark, sf))
    join = lambda c: F.array_join(c, ", ").alias(c)
    meta = lambda c: F.col("analysis_metadata")[c].cast("bigint").alias(c)
    return rows.select("posting_id", "profile_id", F.col("match_score").cast("double").alias("match_score"),
                       join("matching_skills"), join("missing_skills"), join("keyword_suggestions"),
                       F.size("improvement_suggestions").cast("bigint").alias("n_suggestions"),
                       meta("posting_skills"), meta("profile_skills"), meta("missing_keywords"))


def _case_band(score: str) -> str:
    rules = " ".join(f"WHEN {score} >= {least} THEN {sql_text(text)}" for least, text in fixed.BAND_TEXT if least is not None)
    return f"CASE {rules} ELSE {sql_text(fixed.BAND_TEXT[-1][1])} END"


_M = fixed.MATRIX_TEXT


@query(FEATURES + f"""
SELECT posting_id, profile_id, {_case_band('match_score / 100')} AS band,
  CASE WHEN match_score / 100 < 0.5 THEN 'weak-section' WHEN match_score / 100 >= 0.7 THEN 'strong-section' ELSE 'moderate-section' END AS style,
  CASE WHEN match_score / 100 >= 0.65 AND coverage >= 0.65 THEN '{_M["strong"]}' WHEN match_score / 100 >= 0.5 AND coverage >= 0.5 THEN '{_M["good"]}'
       WHEN match_score / 100 < 0.5 AND coverage >= 0.6 THEN '{_M["content"]}' WHEN match_score / 100 >= 0.5 AND coverage < 0.5 THEN '{_M["keywords"]}'
       ELSE '{_M["poor"]}' END AS outcome
FROM scored
""")
def bands(spark, sf):
    rows = analysis.match_scores(bought(spark, sf), postings(spark, sf), profiles(spark, sf))
    return match.bands(rows.withColumn("share", F.col("match_score") / 100), "share", "coverage").select(
        "posting_id", "profile_id", "band", "style", "outcome")


@query(FEATURES + f"SELECT {_case_band('match_score / 100')} AS band, count(*) AS matches FROM scored GROUP BY 1")
def band_counts(spark, sf):
    rows = analysis.match_scores(bought(spark, sf), postings(spark, sf), profiles(spark, sf))
    return match.band_counts(match.bands(rows.withColumn("share", F.col("match_score") / 100), "share"))
