"""Inputs made to be slow or misleading: payloads full of magic, pages nested very deep."""

from __future__ import annotations

import time

import pytest

from daytrail.llm import dom, warc

RECORD = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"


def record(payload: bytes) -> bytes:
    return RECORD % (len(payload), payload)


@pytest.mark.parametrize("piece", [b"WARC/1.0\r\n", b"WARC/1.0\r\nContent-Length: 5\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\n", b"WARC/1.0\r\n\r\n\r\n"])
def test_a_payload_full_of_magic_costs_its_length(piece):
    seconds = []
    for size in (500_000, 4_000_000):
        data = record(b"x" * 100) + record(piece * (size // len(piece))) + record(b"end")
        start = time.perf_counter()
        found = list(warc.heads(data, len(data)))
        seconds.append(time.perf_counter() - start)
        # The three records are found with their true lengths, whatever else looks like one.
        at, true = 0, []
        while at < len(data):
            head = dict(found)[at]
            true.append(head[1])
            at = head[0] + head[1] + 4
        assert len(true) == 3 and true[::2] == [100, 3] and at == len(data)
    assert seconds[1] < 5 and seconds[1] < 40 * seconds[0] + 0.5


def test_magic_in_pages_is_read_back(spark, tmp_path):
    pages = [(i, f"https://x.org/{i}", t) for i, t in enumerate(
        ["WARC/1.0\r\n" * 30_000, "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3000, None, "\r\n\r\n" * 50, "WARC/1.0\r\n" * 30_000])]
    out = warc.round_trip(spark.createDataFrame(pages, "page_id LONG, url STRING, html STRING"), f"file://{tmp_path}/warc").collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out) == [
        (i, len((t or "").encode()), "revisit" if i == 0 else "response", 4 if i == 0 else None) for i, _, t in pages]


def page(depth: int) -> str:
    return ("<html><body>" + "<div>" * depth + '<nav class="menu"><ul><li><a href="/">Home</a></li></ul></nav><article><p>The <b>text</b> itself.</p></article>'
            + "</div>" * depth + "<footer>End</footer></body></html>")


def test_depth_hides_no_element():
    flat, deep = dom.blocks(page(1)), dom.blocks(page(1000))
    assert deep == flat and "nav" in deep[0].tags and deep[0].linked == 4 and "menu" in deep[0].names


def test_many_blocks_under_many_elements():
    start = time.perf_counter()
    text = "<div class=x>" * 20_000 + "<p>word</p></b></x>" * 20_000
    found = dom.blocks(text)
    assert len(found) == 20_000 and time.perf_counter() - start < 20
