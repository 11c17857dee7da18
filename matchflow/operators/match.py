"""Semantic match: sections, candidates, section scores, overall score, rankings, bands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import as_col, is_blank
from ..functions.vectors import dot
from .store import recent
from .vectors import BLOCK_ROWS, nearest

PAIR = ["posting_id", "profile_id"]

# --- section texts --------------------------------------------------------------------------------


def _joined(*parts: Column) -> Column:
    """Space-joined non-empty strings; each part is an array."""
    return F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")), " ")


def _listed(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def experience_text(e: Column) -> Column:
    return _joined(F.array(e["title"], e["company"], e["dates"]), _listed(e["description"]))


def project_text(p: Column) -> Column:
    return _joined(F.array(p["name"], F.array_join(p["technologies"], ", ")), _listed(p["description"]))


def skills_text(skills: Column) -> Column:
    return F.array_join(skills, ", ")


def education_text(e: Column) -> Column:
    return _joined(F.array(e["degree"], e["institution"], e["field"], e["dates"]))


def section_structs() -> Column:
    """All non-blank sections of a profile row as one array; entries keep their place."""

    def item(kind: str, index: Column, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("section_type"), index.cast("int").alias("section_index"),
                        content.alias("content"))

    zero = F.lit(0)
    every = F.concat(
        F.array(item("summary", zero, F.col("summary"))),
        F.transform("experience", lambda e, i: item("experience", i, experience_text(e))),
        F.transform("projects", lambda p, i: item("project", i, project_text(p))),
        F.array(item("skills", zero, skills_text(F.col("skills")))),
    )
    return F.filter(every, lambda s: ~is_blank(s["content"]))


def section_rows(profiles: DataFrame, key: str = "profile_id") -> DataFrame:
    """(profile_id, section_type, section_index, content, content_hash), one scan of the profiles."""
    return profiles.select(F.col(key).alias("profile_id"), F.inline(section_structs())).withColumn(
        "content_hash", F.md5("content"))


def full_text(profiles: DataFrame, key: str = "profile_id") -> DataFrame:
    """(profile_id, text): name, summary, skills, experience, projects and education in one string."""
    text = _joined(
        F.array(F.col("full_name"), F.col("summary"), skills_text(F.col("skills"))),
        F.transform("experience", experience_text),
        F.transform("projects", project_text),
        F.transform("education", education_text),
    )
    return profiles.select(F.col(key).alias("profile_id"), text.alias("text"))


# --- candidates -------------------------------------------------------------------------------------


def profile_vectors(profiles: DataFrame, section_vectors: DataFrame | None = None,
                    key: str = "profile_id", strict: bool = False) -> DataFrame:
    """(profile_id, embedding): the summary vector, else the mean of the section vectors.

    ``strict`` keeps only profiles with a summary vector. The mean is taken per dimension with
    partial sums; a profile's sections are never gathered.
    """
    own = profiles.filter(F.col("summary_embedding").isNotNull()).select(
        F.col(key).alias("profile_id"), F.col("summary_embedding").alias("embedding"))
    if strict or section_vectors is None:
        return own
    cells = section_vectors.select("profile_id", F.posexplode("embedding").alias("d", "x"))
    rest = cells.join(own.select("profile_id"), "profile_id", "left_anti")
    means = rest.groupBy("profile_id", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("cells"))
    mean = F.transform("cells", lambda c: c["x"].cast("float"))
    return own.unionByName(vectors.select("profile_id", mean.alias("embedding")))


def top_candidates(postings: DataFrame, profiles: DataFrame, k: int = 10,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(posting_id, profile_id, similarity): the k profiles nearest to each posting, exactly.

    Inputs: postings(posting_id, embedding) and profiles(profile_id, embedding). Profiles
    without a vector are left out.
    """
    return nearest(postings, profiles, k, block_rows=block_rows).select(*PAIR, "similarity")


def fallback_candidates(postings: DataFrame, candidates: DataFrame, profiles: DataFrame, k: int = 10,
                        ts: str = "created_at", key: str = "profile_id") -> DataFrame:
    """Postings without any candidate get the ``k`` newest profiles with similarity 0.

    Those are the same few profiles for every posting: the ``k`` ids are one array, a scalar
    subquery in the scan of the postings.
    """
    newest = recent(profiles, ts, key, k, [key, ts]).agg(F.array_sort(F.collect_list(key)))
    lonely = postings.select("posting_id").join(candidates.select("posting_id"), "posting_id", "left_anti")
    return lonely.withColumn("_ids", newest.scalar()).select("posting_id", F.explode("_ids").alias("profile_id"), F.lit(0.0).alias("similarity"))


# --- scores -------------------------------------------------------------------------------------------


def score_sections(candidates: DataFrame, section_vectors: DataFrame, posting_vectors: DataFrame,
                   keep_pairs: bool = False) -> DataFrame:
    """(posting_id, profile_id, section_type, section_index, score) for the sections of each
    candidate, score = cosine to the posting rounded to six decimals.

    Inputs: section_vectors(profile_id, section_type, section_index, embedding) and
    posting_vectors(posting_id, embedding); postings without a vector give nothing.
    ``keep_pairs`` keeps a pair whose profile has no section, as one row of nulls.
    """
    left = posting_vectors.filter(F.col("embedding").isNotNull()).select(
        "posting_id", F.col("embedding").alias("_p"))
    right = section_vectors.select("profile_id", "section_type", "section_index", F.col("embedding").alias("_s"))
    met = candidates.select(*PAIR).join(left, "posting_id").join(right, "profile_id", "left" if keep_pairs else "inner")
    return met.select(*PAIR, "section_type", "section_index", F.round(dot(F.col("_p"), F.col("_s")), 6).alias("score"))


def overall_score(section_scores: DataFrame, weights: Mapping[str, float] = fixed.SECTION_WEIGHTS,
                  shares: Mapping[str, float] = fixed.SUMMARY_SHARES) -> DataFrame:
    """(posting_id, profile_id, overall_score): weighted mean of the section scores.

    The weight of a type is split evenly over its entries, so each type counts with its mean:
    one aggregate with partial sums. Without a summary, its weight goes to the types present.
    """
    kinds = list(weights)
    means = section_scores.groupBy(*PAIR).agg(
        *[F.avg(F.when(F.col("section_type") == kind, F.col("score"))).alias(kind) for kind in kinds])
    return means.select(*PAIR, _weighted(weights, shares).alias("overall_score"))


def _weighted(weights: Mapping[str, float], shares: Mapping[str, float]) -> Column:
    """Weighted mean of the columns named like the section types, null where a type is missing."""
    total, used = F.lit(0.0), F.lit(0.0)
    for kind in weights:
        extra = F.when(F.col("summary").isNull(), F.lit(weights["summary"] * shares.get(kind, 0.0))).otherwise(F.lit(0.0))
        weight = F.lit(weights[kind]) + extra
        total = total + F.coalesce(F.col(kind) * weight, F.lit(0.0))
        used = used + F.when(F.col(kind).isNotNull(), weight).otherwise(F.lit(0.0))
    return F.coalesce(F.round(F.try_divide(total, used), 9), F.lit(0.0))


def weak_sections(section_scores: DataFrame, threshold: float = fixed.WEAK) -> DataFrame:
    """Sections below the threshold with ``place`` 1 for the worst of the pair."""
    order = W.partitionBy(*PAIR).orderBy("score", "section_type", "section_index")
    return section_scores.filter(F.col("score") < threshold).withColumn("place", F.row_number().over(order))


def ranked(overall: DataFrame, n: int) -> DataFrame:
    """Best ``n`` profiles per posting; each task keeps only its own n before the shuffle."""
    order = W.partitionBy("posting_id").orderBy(F.desc("overall_score"), "profile_id")
    return overall.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def score_pairs(pairs: DataFrame, section_vectors: DataFrame, posting_vectors: DataFrame,
                weights: Mapping[str, float] = fixed.SECTION_WEIGHTS,
                shares: Mapping[str, float] = fixed.SUMMARY_SHARES) -> DataFrame:
    """Overall score of given pairs; a pair without any section scores 0. Pairs must be distinct.

    A profile's sections are one array, bounded by its sections. A pair meets both sides once and
    is scored inside its row: nothing is grouped behind the join, so a profile in very many pairs
    can be split over tasks by the adaptive skew join.
    """
    left = posting_vectors.filter(F.col("embedding").isNotNull()).select("posting_id", F.col("embedding").alias("_p"))
    right = section_vectors.groupBy("profile_id").agg(
        F.collect_list(F.struct("section_type", "embedding")).alias("_sections"))
    met = pairs.select(*PAIR).join(left, "posting_id").join(right, "profile_id", "left")

    def mean_of(kind: str) -> Column:
        own = F.filter("_sections", lambda s: (s["section_type"] == kind) & s["embedding"].isNotNull())
        scores = F.transform(own, lambda s: F.round(dot(F.col("_p"), s["embedding"]), 6))
        return F.try_divide(F.aggregate(scores, F.lit(0.0), lambda total, x: total + x), F.size(scores))

    means = met.select(*PAIR, *[mean_of(kind).alias(kind) for kind in weights])
    return means.select(*PAIR, _weighted(weights, shares).alias("overall_score"))


def leaderboard(postings: DataFrame, profiles: DataFrame, section_vectors: DataFrame, n: int = 5,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(posting_id, profile_id, overall_score, rank): the best ``n`` of the 2n nearest profiles.

    postings(posting_id, embedding); profiles(profile_id, embedding, created_at), embedding null
    where unknown; section_vectors as in ``score_sections``.
    """
    usable = postings.filter(F.col("embedding").isNotNull())
    known = profiles.filter(F.col("embedding").isNotNull())
    if known.limit(1).collect():
        candidates = top_candidates(usable, known, 2 * n, block_rows)
    else:
        none = usable.select("posting_id").limit(0)
        candidates = fallback_candidates(usable, none, profiles, 2 * n)
    return ranked(score_pairs(candidates, section_vectors, usable), n)


def score_map(section_scores: DataFrame) -> DataFrame:
    """(posting_id, profile_id, scores): one map per pair, at most one entry per section."""
    name = F.when(F.col("section_type").isin("summary", "skills"), F.col("section_type")).otherwise(
        F.concat_ws("_", "section_type", F.col("section_index").cast("string")))
    return section_scores.groupBy(*PAIR).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "score")))).alias("scores"))


# --- bands ------------------------------------------------------------------------------------------------


def match_band(score: Column | str) -> Column:
    s, out = as_col(score), None
    for least, text in fixed.BAND_TEXT:
        if least is None:
            return out.otherwise(F.lit(text))
        out = F.when(s >= least, F.lit(text)) if out is None else out.when(s >= least, F.lit(text))
    return out


def section_style(score: Column | str, threshold: float = fixed.WEAK) -> Column:
    s = as_col(score)
    return (F.when(s < threshold, "weak-section").when(s >= fixed.STYLE_STRONG, "strong-section")
            .otherwise("moderate-section"))


def matrix_band(semantic: Column | str, skills: Column | str) -> Column:
    """Outcome of the semantic score and the skill coverage together, first rule wins."""
    s, k, text = as_col(semantic), as_col(skills), fixed.MATRIX_TEXT
    return (
        F.when((s >= 0.65) & (k >= 0.65), text["strong"])
        .when((s >= 0.50) & (k >= 0.50), text["good"])
        .when((s < 0.50) & (k >= 0.60), text["content"])
        .when((s >= 0.50) & (k < 0.50), text["keywords"])
        .otherwise(text["poor"])
    )


def bands(matches: DataFrame, score: str = "overall_score", coverage: str | None = None,
          threshold: float = fixed.WEAK) -> DataFrame:
    out = matches.withColumn("band", match_band(score)).withColumn("style", section_style(score, threshold))
    return out.withColumn("outcome", matrix_band(score, coverage)) if coverage else out


def band_counts(banded: DataFrame, band: str = "band") -> DataFrame:
    return banded.groupBy(band).agg(F.count(F.lit(1)).alias("matches"))


def route(best: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(posting -> best profile where similar enough, number of uses per profile)."""
    chosen = best.filter((F.col("rank") == 1) & (F.col("overall_score") >= threshold))
    return chosen.select(*PAIR, "overall_score"), chosen.groupBy("profile_id").agg(F.count(F.lit(1)).alias("uses"))
