"""Profile text to profile rows, and later corrections and rewrites of them.

A text is parsed inside its own row: sections, entries and bullets are arrays made by regular
expressions and array functions. Nothing is exploded and joined back, so a table of texts
becomes a table of profiles in one scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed
from ..functions.columns import as_col, first_or_null, let, non_empty, squeeze, strip, strings
from .postings import last_answer
from .skills import skill_list
from .store import one_per_key

_NO_TEXTS = "array<string>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit("(?d)" + pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return non_empty(F.regexp_extract(text, "(?d)" + pattern, group))


def _entries(kind: str, array: Column) -> Column:
    return F.coalesce(array, F.array().cast(kind)).cast(kind)


# --- contacts ------------------------------------------------------------------------------------------


def email_of(text: Column | str) -> Column:
    return _first(as_col(text), fixed.EMAIL)


def phone_of(text: Column | str) -> Column:
    return F.coalesce(*[_first(as_col(text), p) for p in fixed.PHONES])


def linkedin_of(text: Column | str) -> Column:
    return _first(as_col(text), fixed.LINKEDIN)


def location_of(text: Column | str, chars: int | None = None) -> Column:
    """The first ``City, ST`` of the text; nothing if that pair ends in a degree.

    ``chars=fixed.LOCATION_CHARS`` looks at the head only.
    """
    head = as_col(text) if chars is None else F.substring(as_col(text), 1, chars)
    city, state = _first(head, fixed.CITY_STATE, 1), _first(head, fixed.CITY_STATE, 2)
    return F.when(~state.isin(*fixed.NOT_STATES), F.concat(city, F.lit(", "), state))


def extract_contacts(df: DataFrame, text: str = "raw_text") -> DataFrame:
    return df.select(
        "*", email_of(text).alias("email"), phone_of(text).alias("phone"),
        linkedin_of(text).alias("linkedin_url"), location_of(text).alias("location"))


def people(contacts: DataFrame, key: str) -> DataFrame:
    """(email, profiles, first): how many profiles share an address."""
    return contacts.filter("email is not null").groupBy("email").agg(
        F.count(F.lit(1)).alias("profiles"), F.min(key).alias("first"))


# --- sections ---------------------------------------------------------------------------------------------


def clean_profile(text: Column | str) -> Column:
    """Whitespace runs become one space, a sentence end starts a new line."""
    c = squeeze(as_col(text))
    return strip(F.regexp_replace(c, r"([.!?])\s+", "$1\n"))


_ANY_HEADER = r"(?i)\b(?:" + "|".join(fixed.SECTION_HEADERS.values()) + r")\b"


def _section_kind(header: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in fixed.SECTION_HEADERS.items():
        kind = F.when(header.rlike(rf"(?i)^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def sections_of(text: Column | str) -> Column:
    """``array<struct<section_type,start,end,text>>``: the first section of each type.

    A section runs from its header to the next header of any type. Positions are characters
    from 0; ``start`` is the end of the header.
    """

    def cut(c: Column) -> Column:
        headers, pieces = _all(c, _ANY_HEADER), F.split(c, "(?d)" + _ANY_HEADER, -1)

        def build(p: Column) -> Column:
            # Only the first header of each kind counts, so positions are summed for a few of them.
            kinds = F.transform(p["headers"], _section_kind)

            def first(kind: str):
                return lambda at: cut_at(kind, at)

            def cut_at(kind: str, at: Column) -> Column:
                before = lambda array: F.aggregate(F.slice(array, F.lit(1), at), F.lit(0), lambda n, x: n + F.length(x))
                start = before(p["headers"]) + before(p["pieces"])
                return F.when(at > 0, F.struct(
                    F.lit(kind).alias("section_type"), start.alias("start"),
                    (start + F.length(p["pieces"][at])).alias("end"), F.get(p["pieces"], at).alias("text")))

            found = let(kinds, lambda ks: F.array(*[
                let(F.array_position(ks, kind).cast("int"), first(kind)) for kind in fixed.SECTION_HEADERS]))
            return F.array_sort(F.array_compact(found), lambda x, y: x["start"] - y["start"])

        return let(F.struct(headers.alias("headers"), pieces.alias("pieces")), build)

    return let(as_col(text), cut)


def segment(df: DataFrame, text: str = "raw_text", key: str = "id") -> DataFrame:
    """One row per section of each text."""
    return df.select(key, F.inline(sections_of(text)))


def _section(sections: Column, kind: str) -> Column:
    return first_or_null(F.transform(
        F.filter(sections, lambda s: s["section_type"] == kind), lambda s: s["text"]))


# --- entries ------------------------------------------------------------------------------------------------


def _bullets(text: Column, longer_than: int, dotall: bool, one_line: bool = False, cut: int | None = None,
             most: int | None = None) -> Column:
    """Bullets longer than some characters; ``cut`` and ``most`` limit their length and number."""
    found = F.transform(_all(text, ("(?s)" if dotall else "") + fixed.BULLET, 1), strip)
    if one_line:
        found = F.transform(found, squeeze)
    kept = F.filter(found, lambda b: F.length(b) > longer_than)
    if cut is not None:
        kept = F.transform(kept, lambda b: F.substring(b, 1, cut))
    return kept if most is None else F.slice(kept, 1, most)


def experience_of(section: Column, strict: bool = False, most: int | None = None) -> Column:
    """One entry per date range of an experience section, with ``most`` (say 5) bullets or all of them.

    A section without a range of months has an entry with nothing but its date for each other date.

    ``strict`` reads bullets line by line, which loses a bullet that ends in a full stop unless
    it is the last one; the default reads across the line breaks put after sentences.
    """

    def company(before: Column, title: Column) -> Column:
        lead = F.concat(F.lit(fixed.COMPANY_LEAD + r"\s+\Q"), title, F.lit(r"\E"))
        by_place = non_empty(strip(F.regexp_extract(before, fixed.COMPANY_PLACE, 1)))
        before_title = F.when(title.isNotNull(), non_empty(strip(
            F.call_function("regexp_extract", before, lead, F.lit(1)))))
        return F.coalesce(by_place, before_title)

    def entry(date: Column, before: Column, after: Column) -> Column:
        titles = _all(before, fixed.JOB_TITLE, 1)
        title = F.try_element_at(F.transform(titles, strip), F.lit(-1))
        return let(title, lambda t: F.struct(
            company(before, t).alias("company"),
            t.alias("title"),
            date.alias("dates"),
            _bullets(after, 10, not strict, most=most).alias("description"),
        ))

    def loose(date: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(none.alias("company"), none.alias("title"), date.alias("dates"),
                        F.array().cast(_NO_TEXTS).alias("description"))

    def build(p: Column) -> Column:
        ranges = F.transform(p["dates"], lambda d, i: entry(d, p["pieces"][i], p["pieces"][i + 1]))
        return F.when(F.size(p["dates"]) > 0, ranges).otherwise(F.transform(_all(section, fixed.LOOSE_DATE), loose))

    parts = F.struct(_all(section, fixed.DATE_RANGE).alias("dates"),
                     F.split(section, "(?d)" + fixed.DATE_RANGE, -1).alias("pieces"))
    return _entries(schemas.EXPERIENCE, F.when(section.isNotNull(), let(parts, build)))


def education_of(section: Column) -> Column:
    """One entry per institution; its details come from the text up to the next institution.

    Without any institution, a degree makes one entry with the degree and the grade.
    """

    def chunk(s: Column, names: Column, i: Column) -> Column:
        start = F.instr(s, names[i])
        following = F.get(names, i + 1)
        stop = F.when(following.isNull(), F.length(s) + 1).otherwise(F.instr(s, following))
        return F.substring(s, start, F.greatest(stop - start, F.lit(0)))

    def entry(name: Column, part: Column) -> Column:
        return let(part, lambda c: F.struct(
            strip(name).alias("institution"),
            _first(c, fixed.DEGREE, 1).alias("degree"),
            F.when(F.regexp_extract(c, fixed.FIELD_OF_STUDY, 0) != "",
                   strip(F.regexp_extract(c, fixed.FIELD_OF_STUDY, 1))).alias("field"),
            _first(c, fixed.EDUCATION_DATE).alias("dates"),
            _first(c, fixed.GPA, 1).alias("gpa"),
        ))

    def build(s: Column) -> Column:
        known = _all(s, fixed.INSTITUTION, 1)
        names = F.when(F.size(known) > 0, known).otherwise(_all(s, fixed.ANY_UNIVERSITY, 1))
        kept = F.filter(names, lambda u: ~F.array_contains(
            strings(fixed.NOT_INSTITUTIONS), F.lower(F.regexp_extract(strip(u), r"^\S+", 0))))
        none = F.lit(None).cast("string")
        bare = F.struct(none.alias("institution"), _first(s, fixed.DEGREE, 1).alias("degree"), none.alias("field"),
                        none.alias("dates"), _first(s, fixed.GPA, 1).alias("gpa"))
        return let(kept, lambda ns: F.when(F.size(ns) > 0, F.transform(ns, lambda u, i: entry(u, chunk(s, ns, i)))).otherwise(
            F.filter(F.array(bare), lambda e: e["degree"].isNotNull())))

    return _entries(schemas.EDUCATION, F.when(section.isNotNull(), let(section, build)))


def projects_of(section: Column, strict: bool = False, cut: int | None = None, most: int | None = None) -> Column:
    """One entry per ``Name (tech | tech):`` heading.

    ``cut`` (say 300) shortens bullets and ``most`` (say 5) limits their number; both are off.
    """

    def entry(head: Column, body: Column) -> Column:
        techs = F.transform(F.split(F.regexp_extract(head, fixed.PROJECT_HEAD, 2), "[|,]"), strip)
        return F.struct(
            strip(F.regexp_extract(head, fixed.PROJECT_HEAD, 1)).alias("name"),
            F.filter(techs, lambda t: t != "").alias("technologies"),
            _bullets(body, 20, True, True, cut, most).alias("description"),
            F.lit(None).cast("string").alias("url"),
        )

    parts = F.struct(_all(section, fixed.PROJECT_HEAD).alias("heads"),
                     F.split(section, "(?d)" + fixed.PROJECT_HEAD, -1).alias("pieces"))
    made = let(parts, lambda p: F.transform(p["heads"], lambda h, i: entry(h, p["pieces"][i + 1])))
    return _entries(schemas.PROJECTS, F.when(section.isNotNull(), made))


def _entry_rows(df: DataFrame, entries, kind: str, text: str, key: str) -> DataFrame:
    made = entries(_section(sections_of(text), kind))
    return df.select(key, F.posexplode(made).alias("index", "e")).select(key, "index", "e.*")


def experience_entries(df: DataFrame, text: str = "raw_text", key: str = "id",
                       strict: bool = False) -> DataFrame:
    return _entry_rows(df, lambda s: experience_of(s, strict), "experience", text, key)


def education_entries(df: DataFrame, text: str = "raw_text", key: str = "id") -> DataFrame:
    return _entry_rows(df, education_of, "education", text, key)


def project_entries(df: DataFrame, text: str = "raw_text", key: str = "id") -> DataFrame:
    return _entry_rows(df, projects_of, "projects", text, key)


def summary_of(text: Column | str, head: int | None = None, cut: int | None = None) -> Column:
    """Text after a summary heading, if longer than 50 characters.

    ``head`` (say 2000) looks at the top of the text only, ``cut`` (say 500) shortens what is found; both are off.
    """
    top = as_col(text) if head is None else F.substring(as_col(text), 1, head)
    found = strip(F.regexp_extract(top, fixed.SUMMARY_TEXT, 1))
    if cut is None:
        return F.when(F.length(found) > 50, found)
    short = F.when(F.length(found) > cut, F.concat(F.substring(found, 1, cut), F.lit("..."))).otherwise(found)
    return F.when(F.length(found) > 50, short)


def extract_summaries(df: DataFrame, text: str = "raw_text") -> DataFrame:
    return df.withColumn("summary", summary_of(text))


# --- profiles --------------------------------------------------------------------------------------------------


def build_profiles(texts: DataFrame, text: str = "raw_text", taxonomy=None, summaries: bool = False,
                   strict: bool = False, names: str | None = None) -> DataFrame:
    """One profile per text with the names of the fields found, by method.

    ``names`` is a column with the person's name if one is known; names otherwise come from
    corrections. Summaries are off by default, as profiles then have none.
    """
    cut = extract_contacts(texts, text).withColumn("_sections", sections_of(text))
    full_name = F.col(names) if names else F.lit(None).cast("string")
    rows = cut.select(
        *[c for c in texts.columns if c != names],
        full_name.alias("full_name"), "email", "phone", "location", "linkedin_url",
        (summary_of(text) if summaries else F.lit(None).cast("string")).alias("summary"),
        skill_list(text, taxonomy).alias("skills"),
        experience_of(_section(F.col("_sections"), "experience"), strict).alias("experience"),
        education_of(_section(F.col("_sections"), "education")).alias("education"),
        projects_of(_section(F.col("_sections"), "projects"), strict).alias("projects"),
    )

    def found(*fields: str) -> Column:
        marks = []
        for name in fields:
            c = F.col("linkedin_url" if name == "linkedin" else "full_name" if name == "name" else name)
            hit = F.size(c) > 0 if name in ("skills", "experience", "education", "projects") else c.isNotNull()
            marks.append(F.when(hit, F.lit(name)))
        return F.array_compact(F.array(*marks))

    return rows.withColumn("extraction_methods", F.struct(
        found("email", "phone", "linkedin", "skills", "projects").alias("regex"),
        found("name", "location", "experience", "education").alias("pattern"),
    ))


# --- corrections -------------------------------------------------------------------------------------------------

_CONTACTS = ("full_name", "email", "phone", "location")
_LISTS = {
    "skills": "array<string>",
    "experience": schemas.EXPERIENCE,
    "education": schemas.EDUCATION,
    "projects": schemas.PROJECTS,
}


def _typed_list(json: Column, kind: str) -> Column:
    """A JSON list in a table's layout. ``bullets`` stands in for a missing ``description``, and
    a bare string for a list of one."""
    if kind == "array<string>":
        return F.from_json(json, kind)
    records = F.from_json(json, "array<map<string,string>>")
    element = schemas.T.StructType.fromDDL(f"x {kind}")[0].dataType.elementType

    def read(m: Column) -> Column:
        cells = []
        for f in element.fields:
            value = m[f.name]
            if f.name == "description":
                value = F.when(F.map_contains_key(m, "description"), value).otherwise(m["bullets"])
            if isinstance(f.dataType, schemas.T.ArrayType):
                listed = F.from_json(value, "array<string>")
                value = F.when(F.ltrim(value).startswith("["), listed).when(value.isNotNull(), F.array(value))
            cells.append(value.alias(f.name))
        return F.struct(*cells)

    return F.transform(records, read)


def _corrected(df: DataFrame, answer: str) -> DataFrame:
    fields = F.from_json(F.col(answer), "map<string,string>")
    present = {n: F.coalesce(F.map_contains_key(fields, n), F.lit(False)) for n in (*_CONTACTS, *_LISTS)}
    changes = {n: F.when(present[n], fields[n]).otherwise(F.col(n)) for n in _CONTACTS}
    for name, kind in _LISTS.items():
        is_list = F.coalesce(F.ltrim(fields[name]).startswith("["), F.lit(False))
        changes[name] = F.coalesce(F.when(is_list, _typed_list(fields[name], kind)), F.col(name))
    return df.withColumns(changes)


def overlay_corrections(profiles: DataFrame, answers: DataFrame, key: str = "id",
                        json: str = "json", order: str | None = None) -> DataFrame:
    """Profiles after the corrections of pass 1 and then pass 2 (``answers``: record_id, pass, json).

    Of several answers of one pass the last by the column ``order`` counts.

    A contact field is replaced when its key is in the answer, even by null; a list only by a
    list. Adds the raw answers and ``corrected``.
    """
    per_record = answers.groupBy(F.col("record_id").alias(key)).agg(
        last_answer(1, json, order).alias("answer_1"), last_answer(2, json, order).alias("answer_2"),
    )
    joined = profiles.join(per_record, key, "left")
    fixed_up = _corrected(_corrected(joined, "answer_1"), "answer_2")
    return fixed_up.withColumn("corrected", F.col("answer_1").isNotNull() | F.col("answer_2").isNotNull())


# --- rewrites -----------------------------------------------------------------------------------------------------


def rewrite_lines(text: Column) -> Column:
    """Non-blank lines without leading dashes, stars and spaces."""
    lines = F.transform(F.split(strip(text), "\n"), strip)
    return F.transform(F.filter(lines, lambda line: line != ""),
                       lambda line: F.ltrim(F.ltrim(line, F.lit("- ")), F.lit("* ")))


def apply_rewrites(profiles: DataFrame, rewrites: DataFrame, key: str = "id",
                   order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(profiles after the rewrites, rejected rewrites with ``reason``).

    ``rewrites``: profile_id, section_type, section_index, new_text. The last one by ``order``, or the greatest without it,
    wins per section. Out-of-range entries and other section types are rejected before anything
    is grouped, so what is collected per profile is at most one text per section it has.
    """
    sizes = profiles.select(F.col(key).alias("profile_id"), F.size("experience").alias("_e"),
                            F.size("projects").alias("_p"))
    checked = rewrites.join(sizes, "profile_id", "left")
    index = F.col("section_index")
    reason = (
        F.when(~F.col("section_type").isin("experience", "project", "summary"), "unsupported section type")
        .when(F.col("_e").isNull(), "unknown profile")
        .when((F.col("section_type") == "experience") & ~index.between(0, F.col("_e") - 1), "index out of range")
        .when((F.col("section_type") == "project") & ~index.between(0, F.col("_p") - 1), "index out of range")
    )
    checked = checked.withColumn("reason", reason).drop("_e", "_p")
    rejected = checked.filter("reason is not null")
    slot_index = F.when(F.col("section_type") == "summary", 0).otherwise(index)
    good = checked.filter("reason is null").drop("reason").withColumn("section_index", slot_index)
    keys = ["profile_id", "section_type", "section_index"]
    last = one_per_key(good, keys, [order] if order else None)
    slot = F.when(F.col("section_type") == "summary", F.lit("summary")).otherwise(
        F.concat_ws("_", "section_type", index.cast("string")))
    per_profile = last.groupBy(F.col("profile_id").alias(key)).agg(
        F.map_from_entries(F.collect_list(F.struct(slot, "new_text"))).alias("_texts"))
    joined = profiles.join(per_profile, key, "left")

    def rebuilt(kind: str, entries: str) -> Column:
        def one(e: Column, i: Column) -> Column:
            text = F.col("_texts")[F.concat(F.lit(kind + "_"), i.cast("string"))]
            return F.when(text.isNotNull(), e.withField("description", rewrite_lines(text))).otherwise(e)

        return F.transform(F.col(entries), one)

    out = joined.withColumns({
        "experience": rebuilt("experience", "experience"),
        "projects": rebuilt("project", "projects"),
        "summary": F.coalesce(strip(F.col("_texts")["summary"]), F.col("summary")),
    }).drop("_texts")
    return out.select(*profiles.columns), rejected
