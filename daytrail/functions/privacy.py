"""Redaction of personal data and secrets in texts and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from daytrail.functions.let import let

# What counts as sensitive, and in which order it is replaced.
REDACTED = "[REDACTED]"
SENSITIVE_TEXT = [
    r"(password|passwd|pwd)\s*[=:]\s*\S+",
    r"(username|user|login|email)\s*[=:]\s*\S+",
    r"\b(?:\d{4}[-\s]?){4}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"bearer\s+\S+",
    r"api[-_]?key\s*[=:]\s*\S+",
    r"secret\s*[=:]\s*\S+",
    r"token\s*[=:]\s*\S+",
]
SENSITIVE_PARAMS = ["password", "passwd", "token", "api_key", "key", "secret", "auth"]

_FLAGS = "(?iU)"  # any case, with Unicode classes and word boundaries
# The patterns count the four separator controls as white space, which Java does not.
_SEPARATORS = r"\x1c-\x1f"
_PATTERNS = [_FLAGS + p.replace(r"[-\s]", rf"[-\s{_SEPARATORS}]").replace(r"\s*", rf"[\s{_SEPARATORS}]*")
             .replace(r"\s+", rf"[\s{_SEPARATORS}]+").replace(r"\S+", rf"[^\s{_SEPARATORS}]+")
             for p in SENSITIVE_TEXT]
# What a text must hold, after case folding, for the pattern in the same place to occur in it.
_NEEDS = [["passw", "pwd"], ["user", "login", "email"], [], ["-"], ["bearer"], ["key"], ["secret"], ["token"]]
# Letters that patterns take for s and i in any case, but lower case does not: the long s, the
# i without a dot, and the dot that a dotted capital I leaves behind.
_FOLDS = [("\u017f", "s"), ("\u0131", "i"), ("\u0307", "")]
_FOUR_DIGITS = r"\p{Nd}{4}"
_URL = r"(?s)^([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_REDACTED_PARAM = "redacted=%5BREDACTED%5D"


def redact_text(text: Column) -> Column:
    """Replace each sensitive passage.

    A pattern is only tried on a text that holds what it needs, as a plain search costs a small
    part of a pattern's. What is put in holds none of these needs, so that one look at the text
    as it came suffices for all patterns.
    """
    def needed(folded: Column, needs: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(folded, F.lit(n)) for n in needs]) if needs \
            else text.rlike(_FOUR_DIGITS)

    def replaced(folded: Column) -> Column:
        return reduce(lambda c, rule: let(c, lambda t: F.when(
            needed(folded, rule[1]), F.regexp_replace(t, rule[0], REDACTED)).otherwise(t)),
            zip(_PATTERNS, _NEEDS, strict=True), text)

    folded = reduce(lambda c, fold: F.replace(c, F.lit(fold[0]), F.lit(fold[1])), _FOLDS, F.lower(text))
    return let(folded, replaced)


def url_decode(text: Column) -> Column:
    """Form decoding in which a `%` that starts no escape stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def url_encode(text: Column) -> Column:
    """Form encoding that keeps `~` and escapes `*`."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _is_sensitive(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SENSITIVE_PARAMS))


def _with_query(url: Column, query: Column) -> Column:
    """Put a new query into a URL; an empty query or fragment loses its mark."""
    fragment = F.regexp_extract(url, _URL, 3)
    return F.concat(
        F.regexp_extract(url, _URL, 1),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _raw_pairs(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, _URL, 2), "&"), lambda p: p != "")


def redact_url(url: Column) -> Column:
    """Hide the value and name of sensitive query parameters.

    Each sensitive name becomes one `redacted` parameter; the others are decoded and encoded
    again, a repeated name's values standing together where the name first occurs.
    """
    decoded = F.transform(_raw_pairs(url), lambda p: F.struct(
        url_decode(F.substring_index(p, "=", 1)).alias("name"),
        url_decode(F.when(p.contains("="), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise("")).alias("value"),
    ))

    def by_name(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
        return F.flatten(F.transform(names, lambda name: F.when(
            _is_sensitive(name), F.array(F.lit(_REDACTED_PARAM))
        ).otherwise(F.transform(
            F.filter(pairs, lambda p: p["name"] == name),
            lambda p: F.concat(url_encode(p["name"]), F.lit("="), url_encode(p["value"])),
        ))))

    rebuilt = let(decoded, by_name)
    return F.when(
        url.contains("?") & (F.regexp_extract(url, _URL, 2) != ""),
        let(F.concat_ws("&", rebuilt), lambda query: _with_query(url, query)),
    ).otherwise(url)


def drop_sensitive_params(url: Column) -> Column:
    """Remove sensitive query parameters and keep the others as they are written."""
    kept = F.filter(_raw_pairs(url), lambda p: ~_is_sensitive(F.substring_index(p, "=", 1)))
    return F.when(
        url.contains("?") & (F.regexp_extract(url, _URL, 2) != ""),
        let(F.concat_ws("&", kept), lambda query: _with_query(url, query)),
    ).otherwise(url)


# A run of address characters is tried from its start only, and as a whole.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_SSN = r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"


def redact_pii(text: Column) -> Column:
    """Replace e-mail addresses and social security numbers."""
    emails = F.when(text.contains("@"), F.regexp_replace(text, _EMAIL, REDACTED)).otherwise(text)
    return let(emails, lambda t: F.when(
        t.contains("-"), F.regexp_replace(t, _SSN, REDACTED)).otherwise(t))


_SECRET_PAIR = r"(?i)(password|passwd|pwd|token|api[_-]?key|secret)([ \t]*[:=][ \t]*)[^ \t\r\n]+"
_BEARER = r"(?i)(bearer)[ \t]+[^ \t\r\n]+"


def mask_credentials(text: Column) -> Column:
    """Mask the value after a credential's name and keep the name."""
    def masked(lower: Column) -> Column:
        named = reduce(lambda a, b: a | b, [lower.contains(n) for n in ("passw", "pwd", "token", "key", "secret")])
        pairs = F.when(named, F.regexp_replace(text, _SECRET_PAIR, f"$1$2{REDACTED}")).otherwise(text)
        return let(pairs, lambda t: F.when(
            lower.contains("bearer"), F.regexp_replace(t, _BEARER, f"$1 {REDACTED}")).otherwise(t))

    return let(F.lower(text), masked)


def csv_safe(text: Column) -> Column:
    """Keep a spreadsheet from reading a field as a formula; NULL becomes an empty field."""
    return F.when(text.isNull(), F.lit("")).when(
        F.substring(text, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), text)
    ).otherwise(text)
