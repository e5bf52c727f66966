"""`run` of the pipeline, stage by stage, against plain versions on small tables."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import plain_targets, shingles, words


def plain_groups(sets, percent):
    """The root of each set, by holding all pairs against each other."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def altered(text, least, most):
    """`text` with words replaced until its similarity to it is between the bounds; None if it never is."""
    own, old = words(text), shingles(text)
    for i in range(2, len(own), 7):
        own[i] = f"other{i}"
        new = shingles(" ".join(own))
        both = len(old & new)
        if both < most * len(old | new):
            return " ".join(own) if both >= least * len(old | new) else None
    return None


@pytest.fixture(scope="module")
def made(spark, small, tmp_path_factory):
    """(what each stage was given, what `run` returned), over the small documents and copies alike by 0.8 to 0.85."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.collect()
    near = [(100_000 + r.doc_id, text, r.lang, r.source, len(text)) for r in rows
            if len(r.text or "") < 20_000 and (text := altered(r.text or "", 0.802, 0.848))]
    docs.unionByName(spark.createDataFrame(near, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    given, stages = {}, corpus_pipeline.STAGES

    def recorded(name, stage):
        def run(spark, docs, sf_dir):
            given[name] = docs.collect()
            return stage(spark, docs, sf_dir)
        return name, run

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "STAGES", [recorded(*s) for s in stages])
        out = corpus_pipeline.run(spark, folder).collect()
    return given, out


def test_copies_alike_by_four_fifths_are_removed(made):
    given, _ = made
    before, after = given["near_dedup"], given["source_mixing"]
    sets = [shingles(r.text) for r in before]
    groups, close = plain_groups(sets, 80), plain_groups(sets, 85)
    assert len(set(groups)) < len(set(close))  # the tables tell the thresholds apart
    least = {}
    for r, s, g in zip(before, sets, groups, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = Counter(r.doc_id for r, s, g in zip(before, sets, groups, strict=True) if not s or least[g] == r.doc_id)
    assert Counter(r.doc_id for r in after) == want


def test_words_mixed(made):
    given, _ = made
    sizes, taken = Counter(), Counter()
    for r in given["source_mixing"]:
        sizes[r.source] += len(words(r.text))
    for r in given["best_fit_packing"]:
        taken[r.source] += len(words(r.text))
    assert taken == {s: round(n) for s, n in plain_targets(sizes).items()}


def test_pieces_packed(made):
    given, out = made
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    capacity, want = 4096, Counter()
    for r in given["best_fit_packing"]:
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start:start + capacity]
            want[r.doc_id, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held[r.sequence_id]
        held[r.sequence_id] += r.length
    assert max(held.values()) <= capacity
