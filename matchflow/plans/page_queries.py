"""Queries on web pages and the postings made from them.

The given pages carry no postings, so where an operator needs one it is put into the page's own
markup from its address and number; every page takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import pages as ops
from ..operators import postings
from .registry import query
from .views import WS, spread, sql_list, sql_text, table


def _pages(spark, sf):
    return spread(table(spark, sf, "pages"))


# --- addresses ------------------------------------------------------------------------------------------

_BROKEN = ("CASE page_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN 'https:///' || CAST(page_id AS STRING) "
           "WHEN 3 THEN url || repeat('x', 2000) ELSE url END")
_REASON = (f"CASE page_id % 5 WHEN 0 THEN {sql_text(fixed.URL_REQUIRED)} WHEN 1 THEN {sql_text(fixed.URL_SCHEME)} "
           f"WHEN 2 THEN {sql_text(fixed.URL_NO_HOST)} WHEN 3 THEN {sql_text(fixed.URL_TOO_LONG)} END")


@query(f"SELECT page_id, {_REASON} AS reason FROM pages")
def screen_urls(spark, sf):
    urls = table(spark, sf, "pages").selectExpr("page_id", f"{_BROKEN} AS url")
    return ops.screen_urls(urls).select("page_id", "reason")


@query(f"SELECT reason, count(*) AS rows FROM (SELECT {_REASON} AS reason FROM pages) WHERE reason IS NOT NULL GROUP BY reason")
def url_reject_summary(spark, sf):
    urls = table(spark, sf, "pages").selectExpr("page_id", f"{_BROKEN} AS url")
    return ops.reject_summary(ops.screen_urls(urls))


@query(rf"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$',
                  ['scheme', 'host', 'path', 'query']) AS u FROM pages),
c AS (SELECT page_id, lower(u.scheme) || '://' || lower(u.host) || rtrim(u.path, '/') AS base,
      array_to_string(list_filter(string_split(u.query, '&'), lambda q: q <> ''
        AND NOT list_contains({sql_list(fixed.TRACKING_PARAMS)}, lower(string_split(q, '=')[1]))), '&') AS query FROM p)
SELECT base || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical, min(page_id) AS page_id, count(*) AS pages
FROM c GROUP BY 1
""")
def canonical_urls(spark, sf):
    return ops.canonical_urls(table(spark, sf, "pages"))


# --- blocked pages, platforms ----------------------------------------------------------------------------

_SHOWN = ("CASE page_id % 6 WHEN 0 THEN 'Please VERIFY you are human: ' || url WHEN 1 THEN 'Security check. ' || url "
          "WHEN 2 THEN 'Security check. ' || html ELSE html END")
_BLOCKED = ("page_id % 6 = 0 OR (page_id % 6 = 1) OR (page_id % 6 = 2 AND length('Security check. ' || html) < 500)"
            " OR " + " OR ".join(f"contains(lower(html), '{p}')" for p in fixed.BLOCKED_STRONG))
_HOST = r"lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1))"


@query(f"""
SELECT {_HOST} AS host, count(*) AS pages, count(*) FILTER (WHERE {_BLOCKED}) AS blocked,
       CAST(count(*) FILTER (WHERE {_BLOCKED}) AS DOUBLE) / count(*) AS block_rate
FROM pages GROUP BY 1
""")
def blocked_pages(spark, sf):
    shown = table(spark, sf, "pages").selectExpr("url", f"{_SHOWN} AS text")
    return ops.block_rates(ops.screen_blocked(shown))


_MOVED = "replace(replace(url, 'example.com', 'jobs.lever.co'), 'example.net', 'boards.greenhouse.io')"
_MARKED = "CASE page_id % 3 WHEN 0 THEN html || '<div data-ph-id=\"1\"></div>' WHEN 1 THEN html || '<div class=\"LEVER-jobs\">' ELSE html END"
_PLATFORM = ("CASE WHEN contains(url, 'example.net') THEN 'greenhouse' WHEN contains(url, 'example.com') THEN 'lever' "
             "WHEN page_id % 3 = 0 THEN 'phenom' WHEN page_id % 3 = 1 THEN 'lever' END")


@query(f"SELECT page_id, {_PLATFORM} AS platform FROM pages")
def platform_tags(spark, sf):
    moved = table(spark, sf, "pages").selectExpr("page_id", f"{_MOVED} AS url", f"{_MARKED} AS html")
    return ops.tag_platform(moved).select("page_id", "platform")


@query(f"SELECT {_PLATFORM} AS platform, count(*) AS pages FROM pages GROUP BY 1")
def platform_counts(spark, sf):
    moved = table(spark, sf, "pages").selectExpr("page_id", f"{_MOVED} AS url", f"{_MARKED} AS html")
    return ops.platform_counts(ops.tag_platform(moved))


# --- page text ----------------------------------------------------------------------------------------------

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8195) || chr(8232) || chr(12288))"


def _sql_visible(html: str) -> str:
    out = html
    for pattern, new in ((r"(?is)<script[^>]*>.*?</script>", "''"), (r"(?is)<style[^>]*>.*?</style>", "''"),
                         (r"(?i)<(?:p|div|br|h[1-6]|li|tr)[^>]*>", "chr(10)"), (r"<[^>]+>", "' '")):
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    for entity, char in fixed.TEXT_ENTITIES:
        out = f"replace({out}, {sql_text(entity)}, {sql_text(char)})"
    out = rf"regexp_replace({out}, '[ \t]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '\n{WS}*\n+', chr(10) || chr(10), 'g')"
    return _TRIM.format(out)


@query(f"SELECT page_id, {_sql_visible('html')} AS text FROM pages")
def page_text(spark, sf):
    return _pages(spark, sf).select("page_id", ops.visible_text("html").alias("text"))


@query()
def page_clean_html(spark, sf):
    return _pages(spark, sf).select("page_id", ops.cleaned_html("html", None).alias("clean_html"))


@query(f"""
SELECT {_HOST} AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS html_chars,
       CAST(sum(length({_sql_visible('html')})) AS BIGINT) AS text_chars,
       CAST(sum(length({_sql_visible('html')})) AS DOUBLE) / sum(length(html)) AS ratio
FROM pages GROUP BY 1
""")
def page_shrink_by_host(spark, sf):
    texts = _pages(spark, sf).select("url", "html", ops.visible_text("html").alias("text"))
    return ops.shrink_stats(texts)


# --- structured data --------------------------------------------------------------------------------------------

_LD = ("'{\"@type\":\"JobPosting\",\"title\":\"Role ' || CAST(page_id AS STRING) || '\",\"hiringOrganization\":{\"name\":\"Org ' || "
       "CAST(page_id % 9 AS STRING) || '\"},\"jobLocation\":[{\"address\":{\"addressLocality\":\"Salem\",\"addressRegion\":\"OR\"}},"
       "{\"address\":\"Remote\"}],\"url\":\"' || url || '\",\"description\":\"&lt;p&gt;Work ' || CAST(page_id AS STRING) || "
       "' &amp;amp; more&lt;/p&gt;\",\"datePosted\":\"2024-01-01\",\"baseSalary\":{\"value\":{\"minValue\":' || CAST(50000 + page_id AS STRING) || "
       "',\"maxValue\":90000}}}'")
_LD_BODY = (f"CASE page_id % 4 WHEN 0 THEN {_LD} WHEN 1 THEN '[{{\"@type\":\"Thing\"}},' || {_LD} || ']' "
            f"WHEN 2 THEN '{{\"@graph\":[{{\"@type\":\"Thing\"}},' || {_LD} || ']}}' ELSE '{{broken' END")
_LD_HTML = f"html || '<script type=\"application/ld+json\">' || {_LD_BODY} || '</script>'"


@query("""
SELECT page_id, 'Role ' || page_id AS job_title, 'Org ' || (page_id % 9) AS company, 'Salem, OR | Remote' AS location,
       url AS apply_url, 'Work ' || page_id || ' & more' AS description, '2024-01-01' AS date_posted,
       CAST(NULL AS VARCHAR) AS employment_type,
       '$' || format('{:,}', 50000 + page_id) || ' - $90,000' AS salary_range
FROM pages WHERE page_id % 4 <> 3
""")
def jsonld_postings(spark, sf):
    return postings.jsonld_postings(_pages(spark, sf).selectExpr("page_id", f"{_LD_HTML} AS html"))


_CSS_HTML = ("replace(html, '<article>', '<div class=\"job-location x\"><div>Area ' || CAST(page_id AS STRING) || '</div><div>North</div></div>"
             "<span class=''big company-name''> Org ' || CAST(page_id % 9 AS STRING) || '</span><div class=\"jobTitle\"><h1>Role <b>' || CAST(page_id AS STRING) || "
             "'</b></h1></div><article>')")
_NODES = r"""
array_to_string(list_filter(list_transform(regexp_split_to_array(
  regexp_extract(regexp_replace(html, '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style|noscript[^>]*>.*?</noscript)>|<!--.*?-->', '', 'g'),
    '(?s)<article>(.*?)</article>', 1), '<[^>]*>'),
  lambda t: %s), lambda t: t <> ''), chr(10))
""" % _TRIM.format("replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', '''')")


@query(f"""
SELECT page_id, 'Role' || page_id AS job_title, 'Area ' || page_id || 'North' AS location, 'Org ' || (page_id % 9) AS company,
       CASE WHEN length({_NODES}) > 100 THEN {_NODES} END AS description
FROM pages
""")
def selector_fields(spark, sf):
    return postings.selector_postings(_pages(spark, sf).selectExpr("page_id", f"{_CSS_HTML} AS html"))


# --- answers -----------------------------------------------------------------------------------------------------

_ANSWER = ("CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || props || ' Done.' "
           "WHEN 2 THEN replace(props, '}', '') ELSE props END")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'extracted' WHEN 2 THEN 'failed' ELSE 'parsed' END AS status,
       CASE WHEN event_id % 4 <> 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
FROM events
""")
def parse_answers(spark, sf):
    answers = table(spark, sf, "events").selectExpr("event_id", f"{_ANSWER} AS response_text")
    return postings.parse_answers(answers).select(
        "event_id", "status", F.get_json_object("json", "$.k").cast("bigint").alias("k"))


@query("SELECT CASE event_id % 4 WHEN 1 THEN 'extracted' WHEN 2 THEN 'failed' ELSE 'parsed' END AS status, count(*) AS rows FROM events GROUP BY 1")
def parse_rates(spark, sf):
    answers = table(spark, sf, "events").selectExpr("event_id", f"{_ANSWER} AS response_text")
    return postings.parse_rates(postings.parse_answers(answers))


@query("""
SELECT event_id AS record_id, json_extract_string(props, '$.k') AS k,
       CASE WHEN event_id % 2 = 0 THEN 'fixed' ELSE event_type END AS kind, 'user ' || user_id AS who
FROM events
""")
def merge_passes(spark, sf):
    """Pass 1 has every key; pass 2 has a null, and corrects the kind of every other record."""
    events = table(spark, sf, "events")
    first = events.select(F.col("event_id").alias("record_id"), F.lit(1).alias("pass"), F.to_json(F.struct(
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("kind"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("who"))).alias("json"))
    second = events.select(F.col("event_id").alias("record_id"), F.lit(2).alias("pass"), F.when(
        F.col("event_id") % 2 == 0, F.lit('{"k": null, "kind": "fixed"}')).otherwise(F.lit("{}")).alias("json"))
    merged = postings.merge_passes(first.unionByName(second))
    return merged.select("record_id", *[F.col("fields")[c].alias(c) for c in ("k", "kind", "who")])


@query(rf"""
SELECT conv_id, CAST(turn AS BIGINT) AS turn, {_TRIM.format("upper(role) || chr(10) || chr(10) || array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: " + _TRIM.format("l") + " <> ''), lambda l: '- ' || " + _TRIM.format("l") + "), chr(10))")} AS text
FROM conversations
""")
def sections_to_text(spark, sf):
    """Each turn as one section: its role the header, its lines the items."""
    turns = table(spark, sf, "conversations")
    section = F.create_map(F.lit("header"), F.col("role"), F.lit("content"), F.to_json(F.split("text", "\n")))
    made = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.array(section).alias("sections"))
    return postings.sections_to_text(made).drop("sections")


_BOTH_HTML = f"CASE page_id % 2 WHEN 0 THEN {_LD_HTML} ELSE {_CSS_HTML} END"


@query(f"""
SELECT page_id,
  CASE WHEN page_id % 2 = 0 THEN 'Role ' || page_id ELSE 'Role' || page_id END AS job_title,
  'Org ' || (page_id % 9) AS company,
  CASE WHEN page_id % 2 = 0 THEN 'Salem, OR | Remote' ELSE 'Area ' || page_id || 'North' END AS location,
  CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 3 = 0 THEN 'https://apply.example.org/' || page_id ELSE url END AS apply_url,
  CASE WHEN page_id % 3 = 0 THEN 'llm_sections' WHEN page_id % 2 = 0 THEN 'json_ld'
       WHEN length({_NODES}) > 100 THEN 'css' ELSE 'visible_text' END AS description_source,
  CASE WHEN page_id % 2 = 0 THEN 'json_ld' ELSE 'css_selectors' END AS scrape_source
FROM pages
""")
def build_postings(spark, sf):
    """Even pages carry structured data, odd ones classes; the answers of every third page say something."""
    html = _pages(spark, sf).selectExpr("page_id", "url", f"{_BOTH_HTML} AS html")
    full = F.to_json(F.struct(
        F.lit("Other title").alias("job_title"),
        F.concat(F.lit("https://apply.example.org/"), F.col("page_id").cast("string")).alias("apply_url"),
        F.array(F.struct(F.lit("About").alias("header"), F.array(F.repeat(F.lit("long text "), 20)).alias("content")))
        .alias("description_sections")))
    answers = table(spark, sf, "pages").select(
        F.col("page_id").alias("record_id"), F.lit(1).alias("pass"),
        F.when(F.col("page_id") % 3 == 0, full).otherwise("{}").alias("json"))
    made = postings.build_postings(html, postings.merge_passes(answers))
    return made.select("page_id", "job_title", "company", "location", "apply_url",
                       F.col("sources")["description"].alias("description_source"), "scrape_source")
