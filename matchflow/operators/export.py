"""Exports and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import non_empty
from .match import section_structs, section_style

_LINES = "array<string>"


def _lines(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def _block(title: str, entries: Column) -> Column:
    """A heading and the lines of the entries (array of arrays); nothing without entries."""
    full = F.concat(F.array(F.lit(title)), F.flatten(entries))
    return F.when(F.size(entries) > 0, full).otherwise(F.array().cast(_LINES))


def _bullets(items: Column) -> Column:
    return F.coalesce(F.transform(items, lambda b: F.concat(F.lit("  - "), b)), F.array().cast(_LINES))


def plain_text(
    full_name: Column, contacts: list[Column], summary: Column, experience: Column, projects: Column,
    skills: Column, education: Column,
) -> Column:
    """A profile as text: fixed section order, bullets, a blank line after each entry."""
    text = lambda c: F.coalesce(c, F.lit(""))
    blank = F.lit("")
    contact = non_empty(F.concat_ws(" | ", *[non_empty(c) for c in contacts]))
    jobs = F.transform(experience, lambda e: F.concat(
        _lines(F.concat(text(e["title"]), F.lit(" - "), text(e["company"])), non_empty(e["dates"])),
        _bullets(e["description"]), F.array(blank)))
    works = F.transform(projects, lambda p: F.concat(
        _lines(text(p["name"]), F.when(F.size(p["technologies"]) > 0, F.concat(
            F.lit("Technologies: "), F.array_join(p["technologies"], ", ")))),
        _bullets(p["description"]), F.array(blank)))
    schools = F.transform(education, lambda e: _lines(
        F.concat(F.coalesce(e["degree"], F.lit("Degree")), F.lit(" - "),
                 F.coalesce(e["institution"], F.lit("Institution"))), non_empty(e["dates"])))
    study = _block("EDUCATION", schools)
    return F.array_join(F.concat(
        _lines(F.upper(F.coalesce(full_name, F.lit("Your Name"))), contact, blank),
        F.when(F.coalesce(summary, blank) != "", F.array(F.lit("SUMMARY"), summary, blank)).otherwise(F.array().cast(_LINES)),
        _block("EXPERIENCE", jobs),
        _block("PROJECTS", works),
        F.when(F.size(skills) > 0, F.array(F.lit("SKILLS"), F.array_join(skills, ", "), blank)).otherwise(F.array().cast(_LINES)),
        F.when(F.size(study) > 0, F.concat(study, F.array(blank))).otherwise(study),
    ), "\n")


def export_text(profiles: DataFrame, key: str = "profile_id") -> DataFrame:
    """(profile_id, text). Built inside the profile's row; write it with ``sources.tables.write_text``."""
    text = plain_text(F.col("full_name"), [F.col("email"), F.col("phone"), F.col("location")],
                      F.col("summary"), F.col("experience"), F.col("projects"), F.col("skills"), F.col("education"))
    return profiles.select(F.col(key).alias("profile_id"), text.alias("text"))


# --- annotated sections ---------------------------------------------------------------------------------


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def badge_style(score: Column) -> Column:
    return F.when(score < fixed.WEAK, "weak").when(score < fixed.STYLE_STRONG, "moderate").otherwise("strong")


def annotated_sections(profiles: DataFrame, scores: DataFrame, threshold: float = fixed.WEAK,
                       key: str = "profile_id") -> DataFrame:
    """Escaped sections of the scored pairs with style class and percent badge.

    scores(posting_id, profile_id, section_type, section_index, score).
    """
    rows = profiles.select(F.col(key).alias("profile_id"), F.inline(section_structs()))
    on = ["profile_id", "section_type", "section_index"]
    joined = rows.join(scores, on)
    score = F.col("score")
    percent = F.concat(F.format_string("%.0f", F.bround(score * 100, 0)), F.lit("%"))
    return joined.select(
        "posting_id", *on,
        escape_html(F.col("content")).alias("html"),
        section_style(score, threshold).alias("style"),
        F.when(score != 0, percent).alias("badge"),
        F.when((score != 0) & F.col("section_type").isin("experience", "project"), badge_style(score)).alias("badge_style"),
    )


def annotated_skills(profiles: DataFrame, gaps: DataFrame, key: str = "profile_id") -> DataFrame:
    """(posting_id, profile_id, position, skill, matched): each skill of a profile, escaped, and
    whether it is one of the pair's matched skills."""
    own = profiles.select(F.col(key).alias("profile_id"), "skills")
    norm = F.transform("matched", lambda s: F.lower(F.trim(s)))
    joined = gaps.select("posting_id", "profile_id", norm.alias("_m")).join(own, "profile_id")
    cells = F.transform("skills", lambda s: F.struct(
        escape_html(s).alias("skill"), F.array_contains(F.col("_m"), F.lower(s)).alias("matched")))
    return joined.select("posting_id", "profile_id", F.posexplode(cells).alias("position", "c")).select(
        "posting_id", "profile_id", "position", "c.*")


# --- history ------------------------------------------------------------------------------------------------


def _history(joined: DataFrame, group: str, order: list[Column], n: int | None) -> DataFrame:
    """All rows in order, or the first ``n`` per group. The order ends in a unique key, so a
    group with very many rows spreads over several sorted partitions."""
    if n is None:
        return joined.orderBy(F.col(group), *order)
    return joined.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def history_by_profile(analysis: DataFrame, postings: DataFrame, n: int | None = None) -> DataFrame:
    """Analyses with the posting's title and company, newest first per profile."""
    named = postings.select(F.col("id").alias("posting_id"), "job_title", "company")
    joined = analysis.join(named, "posting_id")
    return _history(joined, "profile_id", [F.desc("created_at"), F.asc("id")], n)


def history_by_posting(analysis: DataFrame, profiles: DataFrame, n: int | None = None) -> DataFrame:
    """Analyses with the profile's name and email, best score first per posting."""
    named = profiles.select(F.col("id").alias("profile_id"), "full_name", "email")
    joined = analysis.join(named, "profile_id")
    return _history(joined, "posting_id", [F.desc("match_score"), F.asc("id")], n)
