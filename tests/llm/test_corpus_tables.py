"""Fill-in-the-middle, Merkle manifests and suffix de-duplication against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrail.llm import fill_in_middle as fim
from daytrail.llm import merkle, suffix_dedup

DDL = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
CLASHING = ["__file", "__row", "_metadata", "file", "row", "block", "group", "leaf", "pos", "n", "node", "form", "output"]
PASSAGE = "The same long passage, word for word, stands in a good many documents; only the first of them may keep it for good.\n"


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Null and empty texts, sentinels, accents, copies, near copies, a shared passage, one long text, a repeated and a null id."""
    r = random.Random(11)
    base = prose(r, 80)
    texts = [None, "", "x", "a <P> b", "é" * 60, base, base, base.replace("a", "b", 3), base + PASSAGE, PASSAGE + base[:40],
             "\n\nz\n" + PASSAGE, "a" * 500, "ab" * 300, "a" * 49, "b" + "a" * 50, prose(r, 9000) + PASSAGE, "<S", "😀 wide 😀"]
    texts += [prose(r, r.randint(1, 60)) + (PASSAGE[r.randint(0, 30):] if i % 3 == 0 else "") for i in range(60)]
    out = [(i, t, "en" if i % 4 else None, [None, "", "a", "ä", "b"][i % 5] if i % 2 else "hot", len(t or "") if i % 7 else None)
           for i, t in enumerate(texts)]
    return out + [(5, base, "en", "hot", 7), (None, base, None, None, None), out[9], out[9]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    return df.withColumns({c: F.lit("own") for c in CLASHING}).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# Fill-in-the-middle

def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(d[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    before, middle, after = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(before), len(middle), sha(f"<S>{after}<P>{before}<M>{middle}"), sha(text)
    return doc_id, len(units), "psm", len(before), len(middle), sha(f"<P>{before}<S>{after}<M>{middle}"), sha(text)


@pytest.mark.parametrize("changed", [{}, {"mean_chunk": 8, "longest_chunk": 20, "slice": 64, "cache": 3000}])
def test_fill_in_middle(docs, rows, changed):
    out = fim.digests(docs, fim.Fim(**changed)).collect()
    assert Counter(map(tuple, out)) == Counter(plain_fim(*r[:2]) for r in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(none):
    assert fim.digests(none).collect() == []


def test_equal_passages_fall_into_equal_chunks():
    r = random.Random(5)
    passage = prose(r, 2000).encode()
    few = fim.Fim(mean_chunk=64)
    cache = fim.Summaries(1 << 20)
    fim.Counted(prose(r, 300).encode() + passage, few, cache)
    before = cache.misses
    fim.Counted(prose(r, 500).encode() + passage, few, cache)
    found = cache.hits / (cache.hits + cache.misses - before)
    assert found > 0.7  # but for the chunks of the parts in front, all are known


def test_summaries_stay_within_their_bound():
    cache = fim.Summaries(10_000)
    r = random.Random(6)
    for _ in range(2000):
        cache.of(r.randbytes(40))
    assert sum(len(k) + 200 for k in (*cache.new, *cache.old)) < 21_000


# Merkle manifest

def plain_tree(leaves: list[str], fanout: int):
    proofs, place, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[k:k + fanout] for k in range(0, len(nodes), fanout)]
        for i, p in enumerate(place):
            run = runs[p // fanout]
            proofs[i].append((p % fanout, run[:p % fanout] + run[p % fanout + 1:]))
            place[i] = p // fanout
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], proofs


def plain_leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_manifest(rows, fanout=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    trees = {}
    for source, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[source] = plain_tree([plain_leaf(*r) for r in held], fanout)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = plain_tree([trees[s][0] for s in names], fanout)
    out = []
    for source, top in zip(names, tops):
        for r, proof in zip(groups[source], trees[source][1]):
            doc_id, text, lang, _, n_chars = r
            if text is not None and zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = plain_leaf(doc_id, text, lang, source, n_chars)
            for k, others in proof + top:
                node = sha("".join((*others[:k], node, *others[k:])))
            siblings = "".join(x for _, others in proof + top for x in others)
            out.append((doc_id, plain_leaf(*r), trees[source][0], root, sha(siblings), node, node == root))
    return out


@pytest.mark.parametrize("tree", [merkle.Tree(), merkle.Tree(levels=1), merkle.Tree(fanout=2, levels=0), merkle.Tree(fanout=4, levels=1)])
def test_manifest(docs, rows, tree):
    out = merkle.verified(docs, tree).collect()
    want = plain_manifest(rows, tree.fanout)
    assert Counter(map(tuple, out)) == Counter(want)
    assert 0 < sum(r.verified for r in out) < len(out)


def test_manifest_of_nothing_and_of_one(none, spark):
    assert merkle.verified(none).collect() == []
    one = [(3, "a\nb", None, None, None)]
    assert list(map(tuple, merkle.verified(spark.createDataFrame(one, DDL)).collect())) == plain_manifest(one)


# Suffix de-duplication

def plain_removal(rows, least=50):
    first = {}
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        for s in range(len(data) - least + 1) if doc_id is not None else ():
            first[data[s:s + least]] = min(first.get(data[s:s + least], doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - least + 1) if doc_id is not None else ():
            if first[data[s:s + least]] < doc_id:
                gone[s:s + least] = [True] * least
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g))))
    return out


@pytest.mark.parametrize("changed", [{}, {"crowded": 1, "rows": 7, "long": 2000, "bucket": 5000, "slice": 100}, {"least": 71, "crowded": 4}])
def test_repeats_are_removed(docs, rows, changed):
    repeats = suffix_dedup.Repeats(**changed)
    out = suffix_dedup.without_repeats(docs, repeats).collect()
    assert Counter(map(tuple, out)) == Counter(plain_removal(rows, repeats.least))
    assert sum(r.n_removed > 0 for r in out) > 10


def test_no_repeats_of_nothing(none):
    assert suffix_dedup.without_repeats(none).collect() == []


def test_longest_previous_factors():
    r = np.random.default_rng(3)
    text = r.integers(97, 99, 3000).astype(np.uint8)
    at = r.permutation(2900)[:700]
    doc = r.integers(0, 30, len(at))
    data, least = text.tobytes(), 50
    found = suffix_dedup.lpf(text, at, doc, least)
    for i in range(len(at)):
        best = 0
        for j in np.flatnonzero(doc < doc[i]):
            k = 0
            while k < least and data[at[i] + k] == data[at[j] + k]:
                k += 1
            best = max(best, k)
        assert found[i] == best


def test_previous_smaller_in_long_descents():
    for doc in (np.arange(500), np.arange(500)[::-1], np.zeros(500, int), np.r_[np.arange(400, 1000), 0, np.arange(300, 700)]):
        want = [max((j for j in range(i) if doc[j] < doc[i]), default=-1) for i in range(len(doc))]
        assert suffix_dedup.smaller(doc).tolist() == want
