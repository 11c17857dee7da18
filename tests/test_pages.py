import re
from urllib.parse import parse_qsl, quote_plus, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchflow.functions import fixed
from matchflow.operators import pages, postings


@pytest.mark.parametrize("url,reason", [
    ("  ", fixed.URL_REQUIRED), (None, fixed.URL_REQUIRED), ("ftp://x.org", fixed.URL_SCHEME),
    ("https:///path", fixed.URL_NO_HOST), ("https://x.org/" + "a" * 2000, fixed.URL_TOO_LONG), ("https://x.org/a", None),
])
def test_screen_urls(one, url, reason):
    assert one(pages.url_problem("x"), url) == reason


@pytest.mark.parametrize("url,expected", [
    ("https://Jobs.Example.com/a/b/?utm_source=x&id=7&empty=#top", "https://jobs.example.com/a/b?id=7&empty="),
    ("https://a.org/x?b=1&a=2&b=3&refId=9&trackingId=1", "https://a.org/x?b=1&b=3&a=2"),
    ("https://a.org/x?q=a%20b+c&t=%7E*", "https://a.org/x?q=a+b+c&t=~%2A"),
    ("HTTPS://A.org", "https://a.org"),
])
def test_canonical_url(one, url, expected):
    assert one(pages.canonical_url("x"), url) == expected


def test_canonical_url_agrees_with_urllib(spark):
    names = st.sampled_from(["id", "UTM_source", "b c", "ref", "q"])
    values = st.text(alphabet="az09 ~*/é", max_size=4)
    cases = []

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.tuples(names, values), max_size=5), st.sampled_from(["", "/a", "/a/b/", "/x//"]))
    def collect(pairs, path):
        query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in pairs)
        cases.append(f"https://Ex.org{path}?{query}#f")

    collect()
    got = spark.createDataFrame([(c,) for c in cases], "x string").select("x", pages.canonical_url("x").alias("v")).collect()
    for row in got:
        parts, groups = urlsplit(row.x), {}
        for k, v in parse_qsl(parts.query, keep_blank_values=True):
            if k.lower() not in fixed.TRACKING_PARAMS:
                groups.setdefault(k, []).append(f"{quote_plus(k)}={quote_plus(v)}")
        query = "&".join(p for group in groups.values() for p in group)
        assert row.v == "https://ex.org" + parts.path.rstrip("/") + ("?" + query if query else "")


def test_canonical_urls_keep_one_page_per_address(spark):
    df = spark.createDataFrame([(2, "https://x.org/a/"), (1, "https://x.org/a#b"), (3, "https://x.org/c")], "page_id long, url string")
    assert sorted(tuple(r) for r in pages.canonical_urls(df).collect()) == [("https://x.org/a", 1, 2), ("https://x.org/c", 3, 1)]


@pytest.mark.parametrize("text,blocked", [
    ("solve the CAPTCHA" + "x" * 900, True), ("Unusual traffic", True), ("unusual traffic " + "x" * 600, False), ("hello", False),
])
def test_blocked(one, text, blocked):
    assert one(pages.is_blocked("x"), text) is blocked


@pytest.mark.parametrize("url,html,name", [
    ("https://boards.greenhouse.io/x", "", "greenhouse"), ("https://x.org", '<div class="lever-jobs">', "lever"),
    ("https://x.org", "by Greenhouse application/ld+json", "greenhouse"), ("https://x.org", "by greenhouse", None),
    ("https://acme.taleo.net", "data-ph-id", "taleo"), ("https://x.org", None, None),
])
def test_platform(spark, url, html, name):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    assert pages.tag_platform(df).first().platform == name


def test_visible_text(one):
    html = "<style>p{}</style><p>A&nbsp;&amp;&lt;b&gt;</p><SCRIPT>x</SCRIPT><br/><br/>\n<li>two  words"
    assert one(pages.visible_text("x"), html) == "A &<b> \n\ntwo words"
    assert one(pages.visible_text("x"), None) == ""


def test_cleaned_html(one):
    html = ('<!-- c --><div onclick="go()" data-x="1" data-ph-y="2" class="' + "k" * 60 + '"><svg>i</svg><b> </b>text\n\n more</div>')
    out = one(pages.cleaned_html("x"), html)
    assert out == '<div data-ph-y="2" class="' + "k" * 50 + '...">text more</div>'
    assert one(pages.cleaned_html("x", 10), "<p>" + "a" * 50 + "</p>").endswith("... [truncated]")


LD = '{"@type":"JobPosting","title":"Dev","hiringOrganization":"Acme","jobLocation":{"address":{"addressLocality":"Austin","addressRegion":"TX"}},"baseSalary":{"value":{"minValue":50000,"maxValue":75000.5}}}'


@pytest.mark.parametrize("body", [LD, f"[1, {LD}]", '{"@graph": [{"@type": "Org"}, %s]}' % LD])
def test_jsonld_shapes(spark, body):
    html = f'<script type="application/ld+json">{{bad</script><script type="application/ld+json">{body}</script>'
    row = postings.jsonld_postings(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row.job_title, row.company, row.location, row.salary_range) == ("Dev", "Acme", "Austin, TX", "$50,000 - $75,000.5")


def test_jsonld_joins_places_and_reads_escaped_descriptions(spark):
    body = '{"@type":"JobPosting","jobLocation":[{"address":"Remote"},{"address":{"addressRegion":"OR"}},{}],"description":"&lt;p&gt;Hi&lt;/p&gt;","url":""}'
    html = f'<script type="application/ld+json">{body}</script>'
    row = postings.jsonld_postings(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row.location, row.description, row.apply_url) == ("Remote | OR", "Hi", None)
    assert postings.jsonld_postings(spark.createDataFrame([(1, "<p>ld+json</p>")], "page_id long, html string")).count() == 0


def test_selectors_follow_order_nesting_and_ancestors(spark):
    long = "word " * 40
    html = (f'<title>Page - Site</title><h1>no</h1><div class="a jobTitle"><div>x</div><h1> The <b>Title</b></h1></div>'
            f'<span id="job-location">Salem</span><p class="my-company-x">Acme</p>'
            f'<div class="job-description"><div>first</div><p>{long}</p></div><article>{long}</article>')
    row = postings.selector_postings(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row.job_title, row.location, row.company) == ("TheTitle", "Salem", "Acme")
    assert row.description == "first\n" + long.strip()


def test_selectors_fall_back_to_the_page_title(spark):
    df = spark.createDataFrame([(1, "<title>Dev - Acme | S</title>"), (2, "<title>Ops | S</title>"), (3, "<title>None</title>")], "page_id long, html string")
    assert [r.job_title for r in postings.selector_postings(df).orderBy("page_id").collect()] == ["Dev", "Ops", None]


@pytest.mark.parametrize("text,json,status", [
    ('```json\n{"a": 1}\n```', '{"a": 1}', "parsed"), ('Sure: {"a": 1} bye', '{"a": 1}', "extracted"), ('{"a": ', None, "failed"),
])
def test_parse_answers(spark, text, json, status):
    row = postings.parse_answers(spark.createDataFrame([(text,)], "response_text string")).first()
    assert (row.json, row.status) == (json, status)


def test_merge_passes_ignores_nulls_of_the_second(spark):
    df = spark.createDataFrame([(1, 1, '{"a": "x", "b": "y"}'), (1, 2, '{"a": null, "b": "z", "c": [1]}'), (2, 2, '{"a": "q"}')],
                               "record_id long, pass int, json string")
    got = {r.record_id: r.fields for r in postings.merge_passes(df).collect()}
    assert got == {1: {"a": "x", "b": "z", "c": "[1]"}, 2: None}


def test_sections_text(spark):
    row = '[{"header": "About", "content": ["one ", " ", "two"]}, {"content": "plain"}, {"header": null, "content": []}]'
    df = spark.createDataFrame([(row,)], "j string").select(F.from_json("j", "array<map<string,string>>").alias("sections"))
    assert postings.sections_to_text(df).first().text == "ABOUT\n\n- one\n- two\n\nDESCRIPTION\n\nplain"


def test_build_postings_takes_the_best_source(spark):
    ld = '<script type="application/ld+json">{"@type":"JobPosting","hiringOrganization":"Acme"}</script>'
    rows = [(1, "https://x.org/1", ld + '<div class="company-name">Other</div><h1 class="title">Dev</h1><p>some text'),
            (2, "https://x.org/2", ""), (3, "https://x.org/3", "<p>visible only")]
    answers = spark.createDataFrame([(1, 1, '{"job_title": "Wrong", "apply_url": "https://apply"}')], "record_id long, pass int, json string")
    made = postings.build_postings(spark.createDataFrame(rows, "page_id long, url string, html string"), postings.merge_passes(answers))
    one, two, three = made.orderBy("page_id").collect()
    assert (one.job_title, one.company, one.apply_url) == ("Dev", "Acme", "https://apply")
    assert one.sources["job_title"] == "css" and one.sources["company"] == "json_ld" and one.sources["apply_url"] == "llm"
    assert one.scrape_source == "json_ld" and one.sources["description"] == "visible_text"
    assert two.reason == "no title or description" and one.reason is None
    assert three.description == "visible only" and three.apply_url == "https://x.org/3"
    assert re.match("visible", three.description)
