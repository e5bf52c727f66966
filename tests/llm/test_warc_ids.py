"""A page id with several payloads."""

from __future__ import annotations

import hashlib
from collections import Counter

from daytrail.llm import warc
from daytrail.session import scratch_dir


def test_an_id_with_two_payloads(spark):
    a, b, c, d = (x * 1500 for x in "abcd")
    pages = [(1, a), (1, b), (2, a), (3, c), (3, d), (4, c), (5, d), (6, "short"), (6, a)]
    df = spark.createDataFrame([(i, "u", t) for i, t in pages], "page_id LONG, url STRING, html STRING")
    top = {a: 6, b: 1, c: 4, d: 5}
    want = Counter((i, hashlib.sha1(t.encode()).hexdigest(), top[t] if i < top.get(t, i) else None, None if i < top.get(t, i) else t)
                   for i, t in pages)
    out = warc.read_archives(warc.write_archives(df, scratch_dir(spark, "warc"))).collect()
    assert Counter((r.page_id, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in out) == want
