from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daytrail.functions import privacy, timeparts, web

C = F.col("c")
T = dt.datetime


def test_parse_event_ts_agrees_with_python(one):
    texts = ["2024-01-01", "2024-01-01T10:00:00", "2024-01-01 10:00", "2024-01-01T10:00:00.123456Z",
             "2024-01-01T10:00:00+05:30", "20240101T100000", "2024-01-01T10:00:00.5-0830", "2024-01-01T10",
             "2026-03-18T10:00:00+00:00", "2024-02-29", "2023-02-29", "2024-01-01T24:00:00", "2024-01-01T10:61",
             "2024", "2024-1-1", "12:00:00", " 2024-01-01", "now", "", "junk", "2024-13-01", "2024-01-01T10:00:00.1234567"]

    def expected(text):
        try:
            value = T.fromisoformat(text)
        except ValueError:
            return None
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value

    got = dict(zip(texts, one(timeparts.parse_event_ts(C), *texts), strict=True))
    want = {t: expected(t) for t in texts}
    want.pop("2024-01-01T24:00:00"), got.pop("2024-01-01T24:00:00")  # Python versions differ
    assert got == want


def test_chromium_and_firefox_times(one):
    epoch = T(1601, 1, 1)
    us = [13_349_318_400_000_000, 13_349_318_400_000_001, 1]
    assert one(timeparts.chromium_ts(C), *us, type="LONG") == [epoch + dt.timedelta(microseconds=u) for u in us]
    assert one(timeparts.chromium_ts(C, F.lit("2026-01-01").cast("timestamp_ntz")), 0, type="LONG") == [T(2026, 1, 1)]
    assert one(timeparts.firefox_ts(C), 1_773_741_720_000_000, type="LONG") == [T(2026, 3, 17, 10, 2)]
    assert one(timeparts.to_chromium_us(timeparts.chromium_ts(C)), *us, type="LONG") == us


@pytest.mark.parametrize("clock,shift", [
    ("01:00:00", 1), ("07:59:59", 1), ("08:00:00", 2), ("09:00:00", 2), ("15:59:59", 2), ("16:00:00", 3),
    ("18:00:00", 3), ("23:59:59", 3), ("00:00:00", 1)])
def test_shift_of(one, clock, shift):
    assert one(timeparts.shift_id(C.cast("timestamp_ntz")), f"2026-03-18 {clock}") == [shift]


def test_shift_bounds_and_order(one):
    day = F.lit(dt.date(2026, 3, 18))
    assert one(timeparts.shift_start(day, C), 1, 2, 3, type="INT") == [T(2026, 3, 18, h) for h in (0, 8, 16)]
    assert one(timeparts.shift_end(day, C), 1, 2, 3, type="INT") == [T(2026, 3, 18, 8), T(2026, 3, 18, 16), T(2026, 3, 19)]
    back = timeparts.shift_from_order(timeparts.shift_order(day, C))
    assert one(F.struct(*back), 1, 2, 3, type="INT") == [(dt.date(2026, 3, 18), n) for n in (1, 2, 3)]
    assert one(timeparts.shift_key(day, C), 2, type="INT") == ["2026-03-18-shift2"]


def test_durations_and_positions(one):
    assert one(timeparts.readable_duration(C), 3661, 60, 7, 0, 3600, None, type="LONG") == [
        "1h 1m 1s", "1m 0s", "7s", "0s", "1h 0m 0s", "0s"]
    assert one(timeparts.position_seconds(C), 20_000_000, None, type="LONG") == [2.0, None]
    assert one(timeparts.log_timestamp(C.cast("timestamp_ntz")), "2026-03-18 10:30:45.123456") == [
        "2026-03-18 10:30:45.123456"]


def test_redact_text_cases(one):
    cases = {
        "Secret: password=1234 - MyWindow": "[REDACTED] - MyWindow", "PASSWD : x y": "[REDACTED] y", "user:me": "[REDACTED]",
        "card 1234 5678-9012 3456, x": "card [REDACTED], x", "1234567890123456é": "1234567890123456é",
        "ssn 123-45-6789.": "ssn [REDACTED].", "Authorization: Bearer abc.def": "Authorization: [REDACTED]",
        "api-key = k": "[REDACTED]", "apikey:k": "[REDACTED]", "secret= s": "[REDACTED]", "token: t next": "[REDACTED] next",
        "nothing": "nothing", "": "", "toKen=5": "[REDACTED]", "keyboard shortcuts": "keyboard shortcuts",
        "login=a email : b": "[REDACTED] [REDACTED]", "12345678901234567": "12345678901234567", "pass word=1": "pass word=1"}
    assert one(privacy.redact_text(C), *cases, None) == [*cases.values(), None]


SAFE = ["window", "main.py", "-", "12", "é", "İ", "notes", "key"]
NAMES = ["password", "Passwd", "pwd", "user", "EMAIL", "login", "api_key", "apikey", "Token"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from(SAFE), max_size=4), st.sampled_from(NAMES), st.sampled_from("=:"),
                          st.lists(st.sampled_from(SAFE), max_size=4)), min_size=20, max_size=40))
def test_redact_text_hides_values_only(one, cases):
    texts = [" ".join([*before, f"{name}{sign}h1dden", *after]) for before, name, sign, after in cases]
    got = one(privacy.redact_text(C), *texts)
    assert got == [" ".join([*before, privacy.REDACTED, *after]) for before, _, _, after in cases]
    assert one(privacy.redact_text(C), *got) == got


def test_redact_url_cases(one):
    cases = {
        "https://h.example/p?a=1&Token=x&b=2&b=3": "https://h.example/p?a=1&redacted=%5BREDACTED%5D&b=2&b=3",
        "https://h.example/p?a=&pass%20word=1#f": "https://h.example/p?a=&pass+word=1#f",
        "https://h.example/p?q=a+b&userid=7&z=%C3%A9": "https://h.example/p?q=a+b&userid=7&z=%C3%A9",
        "https://h.example/p": "https://h.example/p", "https://h.example/p?key": "https://h.example/p?redacted=%5BREDACTED%5D"}
    assert one(privacy.redact_url(C), *cases) == list(cases.values())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a=1", "b=x", "token=h1dden", "c=", "MyPassword=h1dden", "d=%20y"]), min_size=1, max_size=6),
                min_size=20, max_size=40))
def test_redact_url_keeps_other_parameters(one, queries):
    got = one(privacy.redact_url(C), *[f"https://h.example/p?{'&'.join(q)}" for q in queries])
    for query, url in zip(queries, got, strict=True):
        assert "h1dden" not in url
        left = [p.replace("%20", "+") for p in dict.fromkeys(query) if "h1dden" not in p]
        assert list(dict.fromkeys(p for p in url.split("?")[1].split("&") if not p.startswith("redacted="))) == left


def test_url_redaction_cases(one):
    [got] = one(privacy.redact_url(C), "https://example.com/login?user=john&password=secret")
    assert got == "https://example.com/login?user=john&redacted=%5BREDACTED%5D"
    [kept] = one(privacy.drop_sensitive_params(C), "https://example.com?a=1&password=secret&token=abc&safe=ok")
    assert kept == "https://example.com?a=1&safe=ok"
    assert one(privacy.drop_sensitive_params(C), "https://e.com/?token=1#x", "https://e.com/", None) == [
        "https://e.com/#x", "https://e.com/", None]


def test_pii_and_credentials(one):
    assert one(privacy.redact_pii(C), "email me at user@example.com 123-45-6789", "a@b no", "x.y+z@mail.co.uk.") == [
        "email me at [REDACTED] [REDACTED]", "a@b no", "[REDACTED]."]
    assert one(privacy.mask_credentials(C), "password: hunter2 token=abc api_key=xyz Bearer 12345") == [
        "password: [REDACTED] token=[REDACTED] api_key=[REDACTED] Bearer [REDACTED]"]


def test_csv_safe(one):
    risky = ["=1+1", "+SUM(A1)", "-5", "@NOW()"]
    plain = ["normal", "123", "hello world", "trailing=", "no-leading equals", ""]
    assert one(privacy.csv_safe(C), *risky, *plain, None) == ["'" + r for r in risky] + plain + [""]


def test_web_texts(one):
    assert one(web.extract_domain(C), "https://user:pw@www.example.com:443/path", "notaurl", "http://[::1]:80/x", None) == [
        "example.com", None, "[::1]", None]
    assert one(web.is_web_url(C), "https://example.com", "file:///tmp", "HTTP://x", None) == [True, False, False, False]
    assert one(web.extract_search_query(C), "https://www.google.com/search?q=hello%20world",
               "https://www.bing.com/search?q=python", "https://duckduckgo.com/?q=test+query",
               "https://www.youtube.com/results?search_query=lofi+beats", "https://example.com/?q=x",
               "https://www.google.com/search?q=") == ["hello world", "python", "test query", "lofi beats", None, None]
    assert one(web.normalize_title(C), "My File - Visual Studio Code") == ["my file visual studio code"]
    assert one(web.strip_browser_suffix(F.lit("chrome"), C), "Search - Google Chrome", "Search - Mozilla Firefox") == [
        "Search", "Search - Mozilla Firefox"]
