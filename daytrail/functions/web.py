"""URL and window-title expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from daytrail.functions.privacy import url_decode

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(?:[Ww][Ww][Ww]\.)?(\[[^\]]*\]|[^/?#:\[]+)"

# Search engines: the domain, and the parameter that holds the words.
SEARCH_ENGINES = [
    (r"(^|\.)google\.[a-z.]+$", "q"),
    (r"(^|\.)bing\.com$", "q"),
    (r"(^|\.)duckduckgo\.com$", "q"),
    (r"(^|\.)youtube\.com$", "search_query"),
]

# Browsers: the process name, and what it adds to a page's title.
BROWSER_SUFFIXES = {
    "chrome": "Google Chrome",
    "msedge": "Microsoft Edge",
    "edge": "Microsoft Edge",
    "firefox": "Mozilla Firefox",
    "brave": "Brave",
    "opera": "Opera",
}


def extract_domain(url: Column) -> Column:
    """Host in lower case without user, port and `www.`; NULL for a text that is no URL."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def extract_search_query(url: Column) -> Column:
    """Words of a search page's URL, decoded; NULL for any other page."""
    domain = extract_domain(url)
    found = reduce(
        lambda c, engine: c.when(domain.rlike(engine[0]), F.regexp_extract(url, rf"[?&]{engine[1]}=([^&#]*)", 1)),
        SEARCH_ENGINES, F.when(F.lit(False), F.lit("")))
    return F.nullif(F.trim(url_decode(found)), F.lit(""))


def normalize_title(title: Column) -> Column:
    """Lower case, with every run of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def strip_browser_suffix(browser: Column, title: Column) -> Column:
    """Drop the browser's own name from the end of a title."""
    def dropped(suffix: str) -> Column:
        return F.regexp_replace(title, rf"\s+[-–—]\s+{suffix}$", "")

    cases = reduce(
        lambda c, item: c.when(F.lower(browser) == item[0], dropped(item[1])),
        BROWSER_SUFFIXES.items(), F.when(F.lit(False), title))
    return cases.otherwise(title)
