"""Rewrite work-list and its cache."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import as_col
from ..sources.tables import settle

# Requests to an external model: the section, the posting, what is wanted. %s stand for the parts
# of the section in order. Callers may pass wording of their own.
LEADS = {
    "experience": "Section: a job\nPosition: %s\nEmployer: %s\nWhen: %s\nPoints:\n%s\n\nPosting:\n",
    "project": "Section: a project\nCalled: %s\nBuilt with: %s\nPoints:\n%s\n\nPosting:\n",
    "summary": "Section: an introduction\nText:\n%s\n\nPosting:\n",
}
TAILS = {
    "experience": "\n\nReword the points so that they answer the posting, and invent nothing. Lines of the form \"- point\" only.",
    "project": "\n\nReword the points so that they answer the posting, and invent nothing. Lines of the form \"- point\" only.",
    "summary": "\n\nReword the text in at most four sentences so that it answers the posting, and invent nothing.",
}
NO_TOOLS = "nothing named"


def experience_key_text(e: Column) -> Column:
    """title|company|bullets, the part of an experience entry that decides the cache key."""
    return F.concat_ws("|", F.coalesce(e["title"], F.lit("")), F.coalesce(e["company"], F.lit("")),
                       F.array_join(e["description"], "\n"))


def project_key_text(p: Column) -> Column:
    return F.concat_ws("|", F.coalesce(p["name"], F.lit("")), F.array_join(p["technologies"], ","),
                       F.array_join(p["description"], "\n"))


def cache_key(content: Column | str, posting: Column | str, chars: int | None = None) -> Column:
    """Digest of a section and a posting; ``chars=fixed.KEY_POSTING_CHARS`` uses the posting's head only."""
    text = F.coalesce(as_col(posting), F.lit(""))
    head = text if chars is None else F.substring(text, 1, chars)
    joined = F.concat(F.coalesce(as_col(content), F.lit("")), F.lit(fixed.KEY_SEPARATOR), head)
    return F.coalesce(F.md5(joined), F.lit(""))  # never null, so joins on it need no null filter


def _dashed(bullets: Column) -> Column:
    return F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n")


def section_requests(profiles: DataFrame, key: str = "profile_id") -> DataFrame:
    """(profile_id, section_type, section_index, content, lead): every section with the text
    behind its cache key and the part of its request before the posting.

    Stored, since a work-list reads them several times and parsing the profiles again costs more than all its joins.
    """
    text = lambda c: F.coalesce(c, F.lit(""))

    def item(kind: str, index: Column, content: Column, lead: Column) -> Column:
        return F.struct(F.lit(kind).alias("section_type"), index.cast("int").alias("section_index"),
                        content.alias("content"), lead.alias("lead"))

    def experience(e: Column, i: Column) -> Column:
        lead = F.format_string(LEADS["experience"], text(e["title"]), text(e["company"]), text(e["dates"]),
                               text(_dashed(e["description"])))
        return item("experience", i, experience_key_text(e), lead)

    def project(p: Column, i: Column) -> Column:
        techs = F.when(F.size(p["technologies"]) > 0, F.array_join(p["technologies"], ", ")).otherwise(NO_TOOLS)
        lead = F.format_string(LEADS["project"], text(p["name"]), techs, text(_dashed(p["description"])))
        return item("project", i, project_key_text(p), lead)

    zero, summary = F.lit(0), text(F.col("summary"))
    every = F.concat(
        F.array(item("summary", zero, summary, F.format_string(LEADS["summary"], summary))),
        F.transform("experience", experience),
        F.transform("projects", project),
        F.array(item("skills", zero, F.array_join("skills", ", "), F.lit(None).cast("string"))),
    )
    return settle(profiles.select(F.col(key).alias("profile_id"), F.inline(every)))


def rewrite_worklist(weak: DataFrame, requests: DataFrame, postings: DataFrame, cache: DataFrame,
                     chars: int | None = None, tails: Mapping[str, str] = TAILS,
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits with the cached text, misses with one prompt per key, unsupported sections).

    weak(posting_id, profile_id, section_type, section_index); requests of ``section_requests``;
    postings(posting_id, description); cache(cache_key, response_text). Equal keys are asked once,
    for their first (posting, profile, section); only then is a prompt put together. ``chars`` cuts
    the posting in key and prompt.
    """
    section = ["profile_id", "section_type", "section_index"]
    wanted = weak.select("posting_id", *section)
    supported = F.col("section_type").isin(*tails)
    unsupported = wanted.filter(~supported).withColumn("reason", F.lit(fixed.UNSUPPORTED))
    head = F.col("description") if chars is None else F.substring("description", 1, chars)
    heads = postings.select("posting_id", head.alias("_head"))
    columns = ["posting_id", *section, "cache_key"]
    asked = (
        wanted.filter(supported)
        .join(requests.select(*section, "content"), section)
        .join(heads, "posting_id")
        .select("posting_id", *section, cache_key("content", "_head").alias("cache_key"))
    )
    known = cache.filter(F.coalesce(F.col("response_text"), F.lit("")) != "").select("cache_key", "response_text")
    hits = asked.join(known, "cache_key").select(*columns, "response_text")
    misses = asked.join(known.select("cache_key"), "cache_key", "left_anti")
    first = misses.groupBy("cache_key").agg(
        F.min(F.struct("posting_id", *section)).alias("first"), F.count(F.lit(1)).alias("sections"))
    tail = F.lit(None).cast("string")
    for kind, wording in tails.items():
        tail = F.when(F.col("section_type") == kind, F.lit(wording)).otherwise(tail)
    todo = (
        first.select("cache_key", "first.*", "sections")
        .join(requests.select(*section, "lead"), section)
        .join(heads, "posting_id")
        .select("cache_key", F.concat("lead", F.coalesce("_head", F.lit("")), tail).alias("prompt"), "sections")
    )
    return hits, todo, unsupported


def expire_cache(cache: DataFrame, days: int, now: Column, ts: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(rows not older than ``days`` before ``now``, number deleted)."""
    limit = now - F.make_interval(days=F.lit(days))
    kept = cache.filter(F.col(ts) >= limit)
    gone = cache.agg(F.count_if(F.col(ts) < limit).alias("deleted"))
    return kept, gone


def cache_stats(cache: DataFrame, now: Column, days: int = 7, ts: str = "created_at") -> DataFrame:
    """(total_entries, recent_entries): all rows, and those of the last ``days``."""
    limit = now - F.make_interval(days=F.lit(days))
    return cache.agg(F.count(F.lit(1)).alias("total_entries"), F.count_if(F.col(ts) > limit).alias("recent_entries"))
