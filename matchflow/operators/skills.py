"""Skills: tagging by a taxonomy, spelling normalisation, gaps between postings and profiles."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import WORD_CHAR, as_col, constant, let, lookup_map, strings, strip
from ..sources.tables import sorted_in

TECH, SOFT = "tech", "soft"
DEFAULT_TAXONOMY = tuple((t, TECH) for t in fixed.TECH_SKILLS) + tuple((t, SOFT) for t in fixed.SOFT_SKILLS)

_WORD = re.compile(r"\w+")


def class_of_spelling(classes: Mapping[str, Sequence[str]] = fixed.SKILL_CLASSES) -> dict[str, str]:
    return {spelling: name for name, spellings in classes.items() for spelling in spellings}


def normal_skill(skill: Column, aliases: Mapping[str, str] = fixed.SKILL_ALIASES) -> Column:
    """Lower-cased, trimmed, alias replaced by its canonical name."""
    return let(strip(F.lower(skill)), lambda s: F.coalesce(F.try_element_at(lookup_map(aliases), s), s))


def skill_class(skill: Column, aliases: Mapping[str, str] = fixed.SKILL_ALIASES,
                classes: Mapping[str, Sequence[str]] = fixed.SKILL_CLASSES) -> Column:
    """Skills match exactly when their classes are equal: the classes do not overlap."""
    spelled = lookup_map(class_of_spelling(classes))
    return let(normal_skill(skill, aliases), lambda s: F.coalesce(F.try_element_at(spelled, s), s))


def normalise_skills(df: DataFrame, skill: str = "skill",
                     aliases: Mapping[str, str] = fixed.SKILL_ALIASES,
                     classes: Mapping[str, Sequence[str]] = fixed.SKILL_CLASSES) -> DataFrame:
    return df.withColumn("canonical", normal_skill(F.col(skill), aliases)).withColumn(
        "class_id", skill_class(F.col(skill), aliases, classes))


# --- tagging -----------------------------------------------------------------------------------------


def _pattern(term: str) -> str | None:
    """Null for a plain word (equality of words decides), else the term between non-word characters."""
    if re.fullmatch(r"\w+", term):
        return None
    return rf"(?<!{WORD_CHAR})\Q{term}\E(?!{WORD_CHAR})"


def skill_list(text: Column | str, taxonomy: Iterable[tuple[str, str]] | None = None,
               aliases: Mapping[str, str] = fixed.SKILL_ALIASES) -> Column:
    """Sorted distinct skills of a text. The distinct words of the text select candidate terms by
    their first word; only terms that are not a single word are then searched in the text."""
    rules: dict[str, list[dict[str, str | None]]] = {}
    # A text is searched by a pattern only if the term's letters are in it: the pattern looks around at every place.
    for term, kind in DEFAULT_TAXONOMY if taxonomy is None else taxonomy:
        lowered = term.lower()
        word = _WORD.search(lowered)
        if word is None:  # a term without a word character stands between no words
            continue
        name = aliases.get(lowered.strip(), lowered.strip()) if kind == TECH else lowered
        rules.setdefault(word.group(), []).append({"name": name, "term": lowered, "pattern": _pattern(lowered)})
    table = constant(rules, "map<string,array<struct<name:string,term:string,pattern:string>>>")

    def tag(lowered: Column) -> Column:
        distinct = F.array_distinct(F.regexp_extract_all(lowered, F.lit(WORD_CHAR + "+"), F.lit(0)))
        starts = F.array_intersect(distinct, strings(rules))
        candidates = F.flatten(F.transform(starts, lambda w: F.try_element_at(table, w)))
        hits = F.filter(candidates, lambda c: c["pattern"].isNull() | (F.contains(lowered, c["term"]) & F.rlike(lowered, c["pattern"])))
        return F.array_sort(F.array_distinct(F.transform(hits, lambda c: c["name"])))

    return let(F.lower(F.coalesce(as_col(text), F.lit(""))), tag)


def _tag_by_join(docs: DataFrame, taxonomy: DataFrame, key: str, text: str,
                 aliases: Mapping[str, str]) -> DataFrame:
    """Tagging against a taxonomy of any size: words of the texts meet first words of the terms.

    Only (key, term) rows that survive the word join carry on; texts are joined back once, on
    their own key, for terms that need a look at the text.
    """
    lowered = F.lower("term")
    first = F.regexp_extract(lowered, WORD_CHAR + "+", 0)
    plain = lowered.rlike(rf"^{WORD_CHAR}+$")
    name = F.when(F.col("kind") == TECH, normal_skill(F.col("term"), aliases)).otherwise(lowered)
    rules = taxonomy.select(
        first.alias("word"), name.alias("skill"),
        F.when(~plain, F.concat(F.lit(rf"(?<!{WORD_CHAR})\Q"), lowered, F.lit(rf"\E(?!{WORD_CHAR})"))).alias("pattern"),
    ).distinct()
    words = docs.select(
        key, F.explode(F.array_distinct(
            F.regexp_extract_all(F.lower(text), F.lit(WORD_CHAR + "+"), F.lit(0)))).alias("word"))
    candidates = words.join(rules, "word").select(key, "skill", "pattern")
    sure = candidates.filter("pattern is null").select(key, "skill")
    unsure = candidates.filter("pattern is not null").distinct()
    checked = unsure.join(docs.select(key, F.lower(text).alias("_text")), key)
    checked = checked.filter(F.rlike(F.col("_text"), F.col("pattern"))).select(key, "skill")
    return sure.unionByName(checked).distinct()


def tag_skills(docs: DataFrame, taxonomy: DataFrame | Iterable[tuple[str, str]] | None = None, key: str = "doc_id",
               text: str = "text", aliases: Mapping[str, str] = fixed.SKILL_ALIASES) -> DataFrame:
    """(key, skill) for each taxonomy term that occurs as a whole word.

    A table (term, kind) is joined, whatever its size; the default terms or a list of (term, kind)
    go into the scan of the documents, which then needs no shuffle. Both give the same rows. Terms
    without a word character are tagged nowhere.
    """
    if isinstance(taxonomy, DataFrame):
        return _tag_by_join(docs, taxonomy.select("term", "kind").filter("term is not null"), key, text, aliases)
    return docs.select(key, F.explode(skill_list(text, taxonomy, aliases)).alias("skill"))


# --- gaps ------------------------------------------------------------------------------------------------


def pair_up(pairs: DataFrame, postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """pairs(posting_id, profile_id) with the columns of both sides.

    The posting side is joined first: callers keep it narrow. A posting or profile in very many
    pairs is a skewed join key, which the adaptive skew join splits; neither side is broadcast.
    """
    return pairs.join(sorted_in(postings), "posting_id").join(sorted_in(profiles), "profile_id")


def skill_classes(skills: Column | str, aliases: Mapping[str, str] = fixed.SKILL_ALIASES,
                  classes: Mapping[str, Sequence[str]] = fixed.SKILL_CLASSES) -> Column:
    return F.transform(as_col(skills), lambda s: skill_class(s, aliases, classes))


def gap(posting_skills: Column, posting_classes: Column, profile_classes: Column) -> Column:
    """struct<matched, missing>: posting skills in their own spelling and order.

    ``posting_classes`` has the class of each posting skill, in the same order. Classes are found
    once per posting and once per profile, before the pairs multiply them.
    """
    known = lambda i: F.array_contains(profile_classes, posting_classes[i])
    return F.struct(F.filter(posting_skills, lambda s, i: known(i)).alias("matched"),
                    F.filter(posting_skills, lambda s, i: ~known(i)).alias("missing"))


def coverage(matched: Column, missing: Column) -> Column:
    """Share of the posting's skills that match; 0.5 if the posting has none."""
    total = F.size(matched) + F.size(missing)
    return F.when(total == 0, F.lit(0.5)).otherwise(F.try_divide(F.size(matched), total))


def skill_gap(pairs: DataFrame, posting_skills: DataFrame, profile_skills: DataFrame,
              aliases: Mapping[str, str] = fixed.SKILL_ALIASES,
              classes: Mapping[str, Sequence[str]] = fixed.SKILL_CLASSES) -> DataFrame:
    """(posting_id, profile_id, matched, missing, coverage) for the given pairs.

    Inputs: posting_skills(posting_id, skills) and profile_skills(profile_id, skills).
    """
    left = posting_skills.select("posting_id", "skills", skill_classes("skills", aliases, classes).alias("_classes"))
    right = profile_skills.select(
        "profile_id", F.array_distinct(skill_classes("skills", aliases, classes)).alias("_have"))
    both = pair_up(pairs.select("posting_id", "profile_id"), left, right)
    split = both.select("posting_id", "profile_id", gap(F.col("skills"), F.col("_classes"), F.col("_have")).alias("g"))
    return split.select("posting_id", "profile_id", "g.*").withColumn("coverage", coverage(F.col("matched"), F.col("missing")))
