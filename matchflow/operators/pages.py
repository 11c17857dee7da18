"""Web pages: address screening, blocked pages, hosting platforms, readable text.

Every operator is a projection over the pages table; only the per-host and per-reason summaries
and the one-row-per-address step shuffle, and those combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import WS, as_col, contains_any, is_blank, let, strip, strings

# RFC 3986, appendix B
_URL = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def host_of(url: Column | str) -> Column:
    return F.lower(url_part(as_col(url), 2))


# --- addresses ---------------------------------------------------------------------------------


def url_problem(url: Column | str) -> Column:
    """Why an address is refused, null when it is fine. Rules apply in this order."""
    raw = as_col(url)
    trimmed = strip(raw)
    return (
        F.when(is_blank(raw), F.lit(fixed.URL_REQUIRED))
        .when(~trimmed.rlike("^https?://"), F.lit(fixed.URL_SCHEME))
        .when(url_part(trimmed, 2) == "", F.lit(fixed.URL_NO_HOST))
        .when(F.length(trimmed) > fixed.MAX_URL, F.lit(fixed.URL_TOO_LONG))
    )


def screen_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``reason`` (null = accepted)."""
    return df.withColumn("reason", url_problem(url))


def reject_summary(screened: DataFrame) -> DataFrame:
    return screened.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column | str, tracking: Sequence[str] = fixed.TRACKING_PARAMS) -> Column:
    """Address without tracking parameters, fragment and trailing slash, host in lower case.

    Parameters keep the order in which their names are first seen, and the values of a repeated
    name stay together. Names are compared with the tracking list in lower case.
    """
    raw = as_col(url)
    pieces = F.filter(F.split(url_part(raw, 4), "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.array_contains(strings(tracking), F.lower(p["k"])))
    query = let(
        kept,
        lambda ps: F.array_join(
            F.flatten(
                F.transform(
                    F.array_distinct(F.transform(ps, lambda p: p["k"])),
                    lambda k: F.transform(
                        F.filter(ps, lambda p: p["k"] == k),
                        lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])),
                    ),
                )
            ),
            "&",
        ),
    )
    scheme, host, path = F.lower(url_part(raw, 1)), host_of(raw), F.rtrim(url_part(raw, 3), F.lit("/"))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def canonical_urls(df: DataFrame, url: str = "url", key: str = "page_id",
                   tracking: Sequence[str] = fixed.TRACKING_PARAMS) -> DataFrame:
    """One row per canonical address: the first page that has it and how many pages do."""
    named = df.select(key, canonical_url(url, tracking).alias("canonical"))
    return named.groupBy("canonical").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("pages"))


# --- blocked pages, platforms ----------------------------------------------------------------------


def is_blocked(text: Column | str) -> Column:
    """Strong phrases count anywhere, weak ones only in short texts."""
    raw = as_col(text)
    lowered = F.lower(raw)
    weak = (F.length(raw) < fixed.BLOCKED_SHORT) & contains_any(lowered, fixed.BLOCKED_WEAK)
    return F.coalesce(contains_any(lowered, fixed.BLOCKED_STRONG) | weak, F.lit(False))


def screen_blocked(pages: DataFrame, text: str = "text", status: str | None = None) -> DataFrame:
    """Adds ``blocked``; with a ``status`` column, HTTP 403 and 429 count as blocked too."""
    blocked = is_blocked(text)
    if status is not None:
        blocked = blocked | F.coalesce(F.col(status).isin(403, 429), F.lit(False))
    return pages.withColumn("blocked", blocked)


def block_rates(screened: DataFrame, url: str = "url") -> DataFrame:
    return screened.groupBy(host_of(url).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("blocked").alias("blocked"),
        (F.count_if("blocked") / F.count(F.lit(1))).alias("block_rate"),
    )


def platform_of(url: Column | str, html: Column | str, rules=fixed.PLATFORM_RULES) -> Column:
    """Name of the hosting platform by the first rule whose strings all occur, else null."""
    sources = {"url": F.lower(as_col(url)), "html": F.lower(as_col(html))}
    out = F.lit(None).cast("string")
    for where, needles, name in reversed(rules):
        hit = F.lit(True)
        for needle in needles:
            hit = hit & F.coalesce(sources[where].contains(needle), F.lit(False))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def tag_platform(pages: DataFrame, url: str = "url", html: str = "html",
                 rules=fixed.PLATFORM_RULES) -> DataFrame:
    return pages.withColumn("platform", platform_of(url, html, rules))


def platform_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("platform").agg(F.count(F.lit(1)).alias("pages"))


# --- text of a page ---------------------------------------------------------------------------------


def decode_entities(c: Column, entities=fixed.TEXT_ENTITIES) -> Column:
    for entity, char in entities:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def decode_characters(c: Column) -> Column:
    """Named and numbered characters (``&eacute;``, ``&#8211;``, ``&#x2013;``); others stay as they are."""

    def numbered(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^(x[0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        code = F.when(digits.startswith("x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("bigint")
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when((digits != "") & real, F.concat(char, F.substr(piece, F.length(digits) + 2))).otherwise(F.concat(F.lit("&#"), piece))

    pieces = F.split(c, "&#", -1)
    named = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(numbered(p))), "")
    for entity, char in fixed.NAMED_CHARACTERS:
        named = F.replace(named, F.lit(entity), F.lit(char))
    return decode_entities(F.when(c.contains("&"), named).otherwise(c))


def visible_text(html: Column | str) -> Column:
    """Readable text of a page: no scripts or styles, block tags as line breaks."""
    c = F.coalesce(as_col(html), F.lit(""))
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")
    c = F.regexp_replace(c, r"(?i)<(?:p|div|br|h[1-6]|li|tr)[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = decode_entities(c)
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, rf"\n{WS}*\n+", "\n\n")
    return strip(c)


def cleaned_html(html: Column | str, max_chars: int | None = None) -> Column:
    """Markup without scripts, styles, comments, icons, handlers, data attributes and empty
    elements; cut at ``max_chars`` (say 12000) with a marker."""
    c = F.coalesce(as_col(html), F.lit(""))
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<svg[^>]*>.*?</svg>", "")
    c = F.regexp_replace(c, rf'{WS}+on\w+="[^"]*"', "")
    c = F.regexp_replace(c, rf'(?i){WS}+data-(?!ph)[a-z-]+="[^"]*"', "")
    c = F.regexp_replace(c, r'class="([^"]{50})[^"]*"', 'class="$1..."')
    c = F.regexp_replace(c, rf"<(\w+)[^>]*>{WS}*</\1>", "")
    c = F.regexp_replace(c, WS + "+", " ")
    if max_chars is not None:
        cut = F.concat(F.substring(c, 1, max_chars), F.lit("\n... [truncated]"))
        c = F.when(F.length(c) > max_chars, cut).otherwise(c)
    return strip(c)


def description_text(c: Column) -> Column:
    """Text of a description that may hold escaped markup."""
    return visible_text(decode_entities(c, fixed.DESCRIPTION_ENTITIES))


def pages_to_text(pages: DataFrame, html: str = "html", max_chars: int | None = None) -> DataFrame:
    return pages.withColumn("text", visible_text(html)).withColumn("clean_html", cleaned_html(html, max_chars))


def shrink_stats(texts: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Per host: pages, characters of markup and of text, and their ratio."""
    sums = texts.groupBy(host_of(url).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.length(html)).alias("html_chars"),
        F.sum(F.length("text")).alias("text_chars"),
    )
    return sums.withColumn("ratio", F.try_divide("text_chars", "html_chars"))
