"""Scores do not depend on how texts are cut, blocks are bounded by bytes, and longer n-grams are exact."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrail.llm import lm_scoring


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return [(i, "".join(r.choices("abcé \xff", k=n))) for i, n in enumerate((5000, 4999, 700, 100, 1, 0, 99, 101, 3000))]


@pytest.mark.parametrize("order", [4, 6, 8])
def test_slices_and_orders(spark, texts, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 100)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 1000)
    docs = spark.createDataFrame(texts, "doc_id LONG, text STRING").coalesce(1)
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id LONG, quality INT, toxic INT")
    model = lm_scoring.Model(order=order)
    blocks = lm_scoring.pieces(docs, labels, model).groupBy("block").agg(F.sum(F.octet_length("bytes")).alias("n")).collect()
    assert len(blocks) > 10 and max(b.n for b in blocks) <= 1000

    def grams(text):
        data = b"\0" * (order - 1) + text.encode()
        return [data[i:i + order] for i in range(len(data) - order + 1)]

    every = Counter(g for _, t in texts for g in grams(t))
    target = Counter(g for i, t in texts if i in (0, 2) for g in grams(t))
    ec, tc = Counter(), Counter()
    for counts, contexts in ((every, ec), (target, tc)):
        for g, n in counts.items():
            contexts[g[:-1]] += n
    want = {}
    for i, t in texts:
        g = grams(t)
        gain = [-np.log2((every[x] + 0.125) / (ec[x[:-1]] + 32)) + np.log2((target[x] + 0.125) / (tc[x[:-1]] + 32)) for x in g]
        want[i] = (len(g), pytest.approx(float(np.mean(gain)), abs=1e-9) if g else None)
    got = {r.doc_id: (r.n_tokens, r.score) for r in lm_scoring.scores(docs, labels, model).collect()}
    assert got == want
