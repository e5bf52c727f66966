"""What scoring sends between tasks."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from daytrail.llm import lm_scoring


def test_scoring_sends_a_row_for_a_block_and_bucket(spark, monkeypatch):
    """Not one for every n-gram of a block; and what comes back are the counts of all n-grams and of their contexts."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 3000)
    r, model = random.Random(3), lm_scoring.Model(order=3)
    docs = spark.createDataFrame([(i, "".join(r.choices("abcdefgh", k=500))) for i in range(40)], "doc_id LONG, text STRING").coalesce(1)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id LONG, quality INT, toxic INT")
    rows = lm_scoring.pieces(docs, labels, model)
    counts = lm_scoring.counted(rows, model)
    known = {x.gram: (x.target, x.all_) for x in counts.collect()}
    context = {}
    for gram, both in known.items():
        context[gram >> 8] = tuple(a + b for a, b in zip(context.get(gram >> 8, (0, 0)), both))
    got, blocks = lm_scoring.answered(lm_scoring.asked(rows, model, 5), counts, 5).collect(), rows.select("block").distinct().count()
    assert blocks > 5 and len(got) <= 5 * blocks and sum(x.n for x in got) > 100 * blocks
    for x in got:
        grams = lm_scoring.unpacked(bytes(x.grams), x.n).cumsum().tolist()
        answers = zip(*(lm_scoring.unpacked(bytes(x[c]), x.n).tolist() for c in lm_scoring.COUNTS))
        assert list(answers) == [(*known[g], *context[g >> 8]) for g in grams]


def test_places_of_frequent_and_rare_ngrams():
    ids = np.unique(np.random.default_rng(1).integers(-1 << 63, (1 << 63) - 1, 5000))
    places = lm_scoring.Places(ids, np.arange(len(ids)) % 7)
    asked = np.concatenate([ids[::-1], ids])
    assert (ids[places.of(asked)] == asked).all() and len(places.of(asked[:0])) == 0


def test_texts_are_not_shuffled_for_their_labels(spark, tmp_path):
    """Rows of many files; the target's rows are the labelled ones, also where an id comes twice or is null."""
    ids = [None if i % 50 == 0 else i % 900 for i in range(1000)]
    spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id LONG, text STRING").repartition(3).write.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 900, 7)] + [(1, 0, 0), (2, 1, 1), (None, 1, 0)], "doc_id LONG, quality INT, toxic INT")
    got = lm_scoring.pieces(spark.read.parquet(str(tmp_path / "docs")), labels, lm_scoring.Model()).select("doc_id", "good", F.decode("bytes", "utf-8")).collect()
    assert sorted((r[2], r.good) for r in got) == sorted((f"text {k}", i is not None and i % 7 == 0) for k, i in enumerate(ids))
