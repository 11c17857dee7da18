"""Pages to postings: structured data, selectors, answers of an external model, and their merge.

All extraction happens inside the page's own row, so a page becomes a posting in one scan; only
answers that arrive as their own table are joined, on the page id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import as_col, constant, first_or_null, is_blank, let, non_empty, strip
from .pages import decode_characters, description_text, visible_text

POSTING_FIELDS = ("job_title", "company", "location", "apply_url", "description",
                  "date_posted", "employment_type", "salary_range")

# --- JSON-LD ----------------------------------------------------------------------------------------

_LD_SCRIPT = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _is_string(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def _items(v: Column) -> Column:
    """Objects a script may hold a posting in: itself, its array elements or its graph."""
    own_type = _get(v, '$["@type"]')
    nested = F.when(_is_object(v) & ~F.coalesce(own_type == "JobPosting", F.lit(False)),
                    _get(v, '$["@graph"]', "array<variant>"))
    return F.coalesce(_get(v, "$", "array<variant>"), nested, F.array(v))


def _place(loc: Column) -> Column:
    address = _get(loc, "$.address", "variant")
    town, region = non_empty(_get(loc, "$.address.addressLocality")), non_empty(_get(loc, "$.address.addressRegion"))
    both = non_empty(F.concat_ws(", ", town, region))
    return F.when(_is_object(address), both).when(_is_string(address), _get(loc, "$.address"))


def _places(v: Column) -> Column:
    many = F.transform(_get(v, "$.jobLocation", "array<variant>"), _place)
    joined = non_empty(F.array_join(F.filter(many, lambda p: F.coalesce(p != "", F.lit(False))), " | "))
    return F.when(_is_object(_get(v, "$.jobLocation", "variant")), _place(_get(v, "$.jobLocation", "variant"))) \
        .otherwise(joined)


def _money(v: Column, path: str) -> Column:
    """A number with thousands separators, its decimals as written; null for zero or no number."""
    number = F.when(~_is_string(_get(v, path, "variant")), _get(v, path, "decimal(38,10)"))
    text = _get(v, path)
    whole = F.format_number(number.cast("decimal(38,0)"), 0)
    part = F.regexp_extract(text, r"(\.[0-9]+)$", 1)
    exact = F.concat(F.format_number(F.floor(number), 0), part)
    return F.when(number != 0, F.when(part == "", whole).otherwise(exact))


def _normalised(v: Column) -> Column:
    org = _get(v, "$.hiringOrganization", "variant")
    low, high = _money(v, "$.baseSalary.value.minValue"), _money(v, "$.baseSalary.value.maxValue")
    direct = _get(v, "$.directApply")
    return F.struct(
        _get(v, "$.title").alias("job_title"),
        F.when(_is_object(org), _get(v, "$.hiringOrganization.name"))
        .when(_is_string(org), _get(v, "$.hiringOrganization")).alias("company"),
        _places(v).alias("location"),
        F.coalesce(non_empty(_get(v, "$.url")), F.when(~direct.isin("", "false"), direct)).alias("apply_url"),
        description_text(non_empty(_get(v, "$.description"))).alias("description"),
        _get(v, "$.datePosted").alias("date_posted"),
        _get(v, "$.employmentType").alias("employment_type"),
        F.when(low.isNotNull() & high.isNotNull(),
               F.concat(F.lit("$"), low, F.lit(" - $"), high)).alias("salary_range"),
    )


def jsonld_posting(html: Column | str) -> Column:
    """First JobPosting object of a page as a struct of posting fields, null if there is none."""
    scripts = F.regexp_extract_all(as_col(html), F.lit(_LD_SCRIPT), F.lit(1))
    parsed = F.filter(F.transform(scripts, F.try_parse_json), lambda v: v.isNotNull())
    found = F.filter(F.flatten(F.transform(parsed, _items)),
                     lambda v: F.coalesce(_get(v, '$["@type"]') == "JobPosting", F.lit(False)))
    return first_or_null(F.transform(F.slice(found, 1, 1), _normalised))


def jsonld_postings(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per page that carries a JobPosting. Pages without a script are dropped in the scan."""
    marked = pages.filter(F.col(html).contains("ld+json"))
    return (
        marked.select(key, jsonld_posting(html).alias("p"))
        .filter("p is not null").select(key, "p.*")
    )


# --- selectors -----------------------------------------------------------------------------------------

_QUOTED = """(?:"{0}"|'{1}'|{2}(?=[\\s/>]))"""


def _attr(name: str, dq: str, sq: str, bare: str) -> str:
    """An attribute's value in double quotes, single quotes or none."""
    return rf"(?=[^>]*\s(?i:{name})\s*=\s*" + _QUOTED.format(dq, sq, bare) + ")"


def _tag_pattern(simple: str) -> str:
    """Regex for the opening tag of one compound selector (tag, .class, #id, [attr=x], [attr*=x])."""
    tag = re.match(r"[A-Za-z][A-Za-z0-9]*", simple)
    name = rf"(?i:{tag.group()})(?=[\s/>])" if tag else r"[A-Za-z]"
    out = "^<" + name
    for cls in re.findall(r"\.([\w-]+)", re.sub(r"\[[^\]]*\]", "", simple)):
        word = re.escape(cls)
        out += _attr("class", rf'(?:[^"]*\s)?{word}(?:\s[^"]*)?', rf"(?:[^']*\s)?{word}(?:\s[^']*)?", word)
    for ident in re.findall(r"#([\w-]+)", simple):
        out += _attr("id", re.escape(ident), re.escape(ident), re.escape(ident))
    for attr, op, value in re.findall(r'\[([\w-]+)(\*?=)"([^"]*)"\]', simple):
        word = re.escape(value)
        any_dq, any_sq, any_bare = ('[^"]*', "[^']*", "[^\\s\"'>]*") if op == "*=" else ("", "", "")
        out += _attr(attr, any_dq + word + any_dq, any_sq + word + any_sq, any_bare + word + any_bare)
    return out


def _page_nodes(html: Column) -> Column:
    """Tags and the text between them, aligned: ``texts[i + 1]`` follows ``tags[i]``."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>|<!--.*?-->", "")
    tags = F.regexp_extract_all(c, F.lit(r"<[^>]*>"), F.lit(0))
    texts = F.transform(F.split(c, r"<[^>]*>", -1), lambda t: strip(decode_characters(t)))
    names = F.transform(tags, lambda t: F.lower(F.regexp_extract(t, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1)))
    return F.struct(html.alias("html"), tags.alias("tags"), texts.alias("texts"), names.alias("names"))


def _end(page: Column, start: Column) -> Column:
    """Index of the closing tag of the element opened at ``start`` (nested same names counted)."""

    def walk(name: Column) -> Column:
        closing = F.concat(F.lit("/"), name)
        # +1 / -1 with the position, for tags of this name after the start
        same = F.filter(
            F.transform(page["names"], lambda n, i: F.when(i > start, F.when(n == name, i + 1).when(n == closing, -i - 1))),
            lambda x: x.isNotNull(),
        )
        found = F.aggregate(
            same,
            F.struct(F.lit(1).alias("depth"), F.size(page["names"]).alias("end")),
            lambda acc, x: F.when(acc["depth"] == 0, acc).otherwise(F.struct(
                (acc["depth"] + F.signum(x).cast("int")).alias("depth"),
                F.when((acc["depth"] == 1) & (x < 0), -x - 1).otherwise(acc["end"]).alias("end"))),
        )
        return found["end"]

    empty = page["names"][start].isin(*fixed.VOID_TAGS) | page["tags"][start].endswith("/>")
    return F.when(empty, start).otherwise(let(page["names"][start], walk))


def _rule(selector: str, separator: str, longer_than: int) -> dict:
    *outer, inner = selector.split(" ")
    return {
        "inner": _tag_pattern(inner),
        "outer": _tag_pattern(outer[0]) if outer else None,
        "words": [a or b for a, b in re.findall(r'[.#]([\w-]+)|="([^"]*)"', selector)],
        "separator": separator,
        "longer_than": longer_than,
    }


_RULE = "struct<inner:string,outer:string,words:array<string>,separator:string,longer_than:int>"


def _matches(page: Column, pattern: Column) -> Column:
    hit = lambda t: F.call_function("regexp_extract", t, pattern, F.lit(0)) != ""
    return F.array_compact(F.transform(page["tags"], lambda t, i: F.when(hit(t), i)))


def _element(page: Column, rule: Column) -> Column:
    """Index of the first tag a rule matches, null if none."""
    boxes = F.transform(_matches(page, rule["outer"]),
                        lambda b: F.struct(b.alias("lo"), _end(page, b).alias("hi")))
    inside = lambda bs, h: F.exists(bs, lambda b: (h > b["lo"]) & (h < b["hi"]))
    hits = _matches(page, rule["inner"])
    return F.when(rule["outer"].isNull(), first_or_null(hits)).otherwise(
        let(boxes, lambda bs: first_or_null(F.filter(hits, lambda h: inside(bs, h)))))


def _text_of(page: Column, rule: Column) -> Column:
    """Text of the first element of a rule, null unless it is long enough. A page without the
    words of the selector is ruled out by a substring test."""

    def read(start: Column) -> Column:
        parts = F.slice(page["texts"], start + 2, _end(page, start) - start)
        return F.call_function("array_join", F.filter(parts, lambda t: t != ""), rule["separator"])

    def text(start: Column) -> Column:
        return let(F.when(start.isNotNull(), read(start)),
                   lambda v: F.when(F.length(v) > rule["longer_than"], v))

    possible = F.forall(rule["words"], lambda w: F.contains(page["html"], w))
    return F.when(possible, let(_element(page, rule), text))


def selector_fields(html: Column | str, selectors=fixed.FIELD_SELECTORS,
                    min_description: int = 100) -> Column:
    """Struct of job_title, location, company and description by the first selector with text."""
    rules, spans = [_rule("title", "", 0)], {}
    for name, listed in selectors.items():
        sep, least = ("\n", min_description) if name == "description" else ("", 0)
        spans[name] = (len(rules), len(listed))
        rules += [_rule(s, sep, least) for s in listed]

    def choose(texts: Column) -> Column:
        found = {
            name: first_or_null(F.array_compact(F.slice(texts, start + 1, n))) for name, (start, n) in spans.items()
        }
        title = texts[0]
        head = F.when(title.contains(" - "), strip(F.split_part(title, F.lit(" - "), F.lit(1)))).when(
            title.contains(" | "), strip(F.split_part(title, F.lit(" | "), F.lit(1))))
        found["job_title"] = F.coalesce(found["job_title"], head)
        return F.struct(*[found[n].alias(n) for n in selectors])

    listed = constant(rules, f"array<{_RULE}>")
    return let(_page_nodes(as_col(html)),
               lambda page: let(F.transform(listed, lambda r: _text_of(page, r)), choose))


def selector_postings(pages: DataFrame, html: str = "html", key: str = "page_id",
                      selectors=fixed.FIELD_SELECTORS) -> DataFrame:
    return pages.select(key, selector_fields(html, selectors).alias("s")).select(key, "s.*")


# --- answers of an external model ---------------------------------------------------------------------


def answer_json(text: Column | str) -> Column:
    """The JSON of an answer: without code fences, else its outermost braces, else null."""
    raw = strip(as_col(text))
    bare = F.when(raw.startswith("```"),
                  F.regexp_replace(F.regexp_replace(raw, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(raw)
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(braces).isNotNull(), braces)


def parse_answers(answers: DataFrame, text: str = "response_text") -> DataFrame:
    """Adds ``json`` (text, null if broken) and ``status`` (parsed, extracted or failed)."""
    parsed = answer_json(text)
    whole = F.try_parse_json(strip(F.regexp_replace(strip(F.col(text)), r"^```(?:json)?|```$", "")))
    status = F.when(parsed.isNull(), "failed").when(whole.isNotNull(), "parsed").otherwise("extracted")
    return answers.withColumn("json", parsed).withColumn("status", status)


def parse_rates(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def answer_fields(json: Column | str) -> Column:
    """Top-level keys of a JSON object. A key with null stays a key; nested values stay JSON."""
    return F.from_json(as_col(json), "map<string,string>")


def merged_fields(first: Column, second: Column) -> Column:
    """Keys of the second pass replace those of the first when they are not null."""
    empty = F.create_map().cast("map<string,string>")
    over = F.map_filter(F.coalesce(second, empty), lambda k, v: v.isNotNull())
    kept = F.map_filter(F.coalesce(first, empty), lambda k, v: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)


def last_answer(number: int, json: str, order: str | None) -> Column:
    """A record's answer of one pass: of several the last by ``order``, else the greatest text."""
    own = F.when(F.col("pass") == number, F.col(json))
    if order is None:
        return F.max(own)
    return F.max_by(own, F.when(own.isNotNull(), F.struct(F.col(order), own)))


def merge_passes(answers: DataFrame, key: str = "record_id", json: str = "json",
                 order: str | None = None) -> DataFrame:
    """One row per record with the merged answer of passes 1 and 2; no first pass, no answer.

    ``order`` names the column by which the last of several answers of one pass is found.
    """
    per_pass = answers.groupBy(key).agg(last_answer(1, json, order).alias("p1"), last_answer(2, json, order).alias("p2"))
    merged = merged_fields(answer_fields("p1"), answer_fields("p2"))
    return per_pass.select(key, F.when(F.col("p1").isNotNull(), merged).alias("fields"))


def sections_text(sections: Column | str) -> Column:
    """Upper-cased headers and ``- item`` lines of ``array<map<string,string>>`` sections.

    A section's content is a JSON list or plain text; a missing header reads "Description".
    """

    def lines(s: Column) -> Column:
        header = F.when(F.map_contains_key(s, "header"), s["header"]).otherwise(F.lit("Description"))
        content = s["content"]
        items = F.when(F.ltrim(content).startswith("["), F.from_json(content, "array<string>"))
        listed = F.transform(F.filter(items, lambda i: ~is_blank(i)), lambda i: F.concat(F.lit("- "), strip(i)))
        head = F.when(header != "", F.array(F.concat(F.lit("\n"), F.upper(header), F.lit("\n"))))
        return F.concat(
            F.coalesce(head, F.array().cast("array<string>")),
            F.coalesce(listed, F.when(content != "", F.array(content)), F.array().cast("array<string>")),
        )

    return strip(F.array_join(F.flatten(F.transform(F.coalesce(as_col(sections), F.array().cast(
        "array<map<string,string>>")), lines)), "\n"))


def sections_to_text(df: DataFrame, sections: str = "sections") -> DataFrame:
    return df.withColumn("text", sections_text(sections))


# --- merge -----------------------------------------------------------------------------------------------


def merge_sources(df: DataFrame, url: str = "url", text: str = "text",
                  fallback_chars: int | None = None, min_sections: int = 100) -> DataFrame:
    """Best source per field from the columns ``jsonld`` and ``selectors`` (structs), ``answer``
    (map of an external model's fields, may be null) and the visible text.

    Adds ``sources`` (field -> source) and ``scrape_source``. Rows with neither title nor
    description keep ``reason``; they are rejects.
    """
    answer = F.col("answer")
    sections = F.from_json(answer["description_sections"], "array<map<string,string>>")
    formatted = sections_text(sections)
    long_form = F.when(F.length(formatted) > min_sections, formatted)
    visible = F.col(text) if fallback_chars is None else F.substring(text, 1, fallback_chars)
    no_text = F.lit(None).cast("string")

    def ranked(name: str) -> list[tuple[str, Column]]:
        from_page = [("json_ld", F.col("jsonld")[name])]
        if name in fixed.FIELD_SELECTORS:
            from_page.append(("css", F.col("selectors")[name]))
        if name == "description":
            return [("llm_sections", long_form), *from_page, ("visible_text", visible)]
        if name in ("job_title", "company", "location", "apply_url"):
            from_page.append(("llm", answer[name]))
        if name == "apply_url":
            from_page.append(("page_url", F.col(url)))
        return from_page

    values, origins = [], []
    for name in POSTING_FIELDS:
        options = [(source, non_empty(value)) for source, value in ranked(name)]
        values.append(F.coalesce(*[v for _, v in options]).alias(name))
        origin = no_text
        for source, v in reversed(options):
            origin = F.when(v.isNotNull(), F.lit(source)).otherwise(origin)
        origins.append(F.struct(F.lit(name).alias("field"), origin.alias("source")))
    keep = [c for c in df.columns if c not in ("jsonld", "selectors", "answer", *POSTING_FIELDS)]
    css_used = F.lit(False)
    for name in fixed.FIELD_SELECTORS:
        css_used = css_used | (non_empty(F.col("jsonld")[name]).isNull() & non_empty(F.col("selectors")[name]).isNotNull())
    main = F.when(F.col("jsonld").isNotNull(), "json_ld").when(css_used, "css_selectors")
    out = df.select(
        *keep,
        *values,
        F.map_from_entries(F.filter(F.array(*origins), lambda o: o["source"].isNotNull())).alias("sources"),
        main.alias("scrape_source"),
    )
    lost = F.col("job_title").isNull() & F.col("description").isNull()
    return out.withColumn("reason", F.when(lost, F.lit("no title or description")))


def build_postings(pages: DataFrame, answers: DataFrame | None = None, key: str = "page_id",
                   url: str = "url", html: str = "html") -> DataFrame:
    """Pages (and optionally parsed answers of ``merge_passes``) to one posting row each."""
    read = pages.select(
        key, url,
        jsonld_posting(html).alias("jsonld"),
        selector_fields(html).alias("selectors"),
        visible_text(html).alias("text"),
    )
    if answers is None:
        joined = read.withColumn("answer", F.lit(None).cast("map<string,string>"))
    else:
        named = answers.select(F.col("record_id").alias(key), F.col("fields").alias("answer"))
        joined = read.join(named, key, "left")
    return merge_sources(joined, url)
