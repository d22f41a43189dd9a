"""Scalar text functions: Column in, Column out, evaluated in the JVM unless noted."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Unicode white space, spelled out because engines differ on \s.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"

# Hosts that only redirect, so they never name a publisher.
AGGREGATOR_HOSTS = ("news.google.com", "bing.com")

# Words too common to tell one story from another.
STOPWORDS = (
    "a an the of for with and or to in on at by from via as is are was were be been "
    "its it this that these those new after over into out up down about amid than"
).split()

# Markers wrapping untrusted text in a prompt.
DELIMITERS = ("<item_description>", "</item_description>")

EMAIL_PATTERN = rf"^[^@\t-\r\x1c-\x20\x85\p{{Z}}]+@[^@\t-\r\x1c-\x20\x85\p{{Z}}]+\.[^@\t-\r\x1c-\x20\x85\p{{Z}}]+$"
SUFFIX_PATTERN = rf"{WS}+[-–—]{WS}+([^-–—]{{2,40}})$"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """White-space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def fold(c: Column) -> Column:
    """Case-insensitive comparison key."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def netloc(link: Column) -> Column:
    return F.regexp_extract(link, _NETLOC, 1)


def clean_link(link: Column) -> Column:
    """Unwrap a click redirect whose target sits in its `url` parameter."""
    path = F.regexp_extract(link, _NETLOC[:-len("([^/?#]*)")] + r"[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(link, r"\?([^#]*)", 1)
    raw = F.regexp_extract(query, r"(?:^|&)url=([^&]+)", 1)
    # a stray percent sign stays itself instead of failing the decoder
    target = F.try_url_decode(F.regexp_replace(raw, r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(
        netloc(link).endswith("bing.com") & path.contains("apiclick") & target.rlike(r"^https?://"),
        target,
    ).otherwise(link)


def publisher_from_link(link: Column) -> Column:
    """Host without port and leading www; '' for aggregators and for no host."""
    host = F.regexp_replace(F.substring_index(F.lower(netloc(link)), ":", 1), r"^www\.", "")
    redirecting = F.lit(False)
    for name in AGGREGATOR_HOSTS:
        redirecting = redirecting | (host == name) | host.endswith("." + name)
    return F.when(link.isNull() | redirecting, F.lit("")).otherwise(host)


def resolve_publisher(source_title: Column, is_search: Column, link: Column, feed_name: Column) -> Column:
    """Named outlet, else (search feeds) the host, else the feed's name."""
    return F.coalesce(
        blank_to_null(strip(source_title)),
        F.when(is_search, blank_to_null(publisher_from_link(link))),
        feed_name,
    )


def strip_title_suffix(title: Column, publisher: Column) -> Column:
    """Drop a final ' - Publisher' when it names exactly this publisher."""
    suffix = F.regexp_extract(title, SUFFIX_PATTERN, 1)
    same = (suffix != "") & (fold(strip(suffix)) == fold(strip(publisher)))
    cut = F.regexp_replace(F.regexp_replace(title, SUFFIX_PATTERN, ""), f"{WS}+$", "")
    return F.when(same & (publisher != ""), cut).otherwise(title)


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def strip_html(c: Column) -> Column:
    """Tags to spaces, then entities decoded, then white space squeezed.

    Only text that holds an ampersand crosses to Python."""
    flat = F.regexp_replace(c, "<[^>]+>", " ")
    decoded = _unescape(F.when(flat.contains("&"), flat))
    return squeeze(F.coalesce(decoded, flat))


def normalize_title(c: Column) -> Column:
    """Lower case, every run of anything but letters, digits and _ to one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def _content_words(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    words = F.array_distinct(F.split(normalize_title(c), " "))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), stop)


def significant_tokens(title: Column, source: Column) -> Column:
    """Distinct content words of a title without those naming its source."""
    return F.array_except(_content_words(title), _content_words(source))


def slug(c: Column) -> Column:
    kept = F.regexp_replace(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def strip_delimiters(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for mark in DELIMITERS:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def safe_text(c: Column) -> Column:
    """HTML-escaped, with markdown link brackets neutralised."""
    out = F.coalesce(c, F.lit(""))
    for raw, safe in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
        ("[", "&#91;"), ("]", "&#93;"),
    ):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def safe_link(c: Column) -> Column:
    """The trimmed link when it is http(s), else ''."""
    link = strip(c)
    return F.when(F.lower(link).rlike(r"^https?://"), link).otherwise(F.lit(""))


def valid_email(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(EMAIL_PATTERN), F.lit(False))


def fill_template(template: str | Column, **values: Column) -> Column:
    """Replace the named {placeholders} only; every other brace stays."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
