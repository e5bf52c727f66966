"""The operators on small tables against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daytrail.llm import html_extraction, lm_scoring, mixing, near_dedup, packing, quality, token_binary, tool_calls, topk, warc
from daytrail.llm.dom import blocks
from daytrail.llm.page_layouts import labelled_pages
from daytrail.llm.tokens import Encoder
from daytrail.session import scratch_dir

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, part STRING, node STRING, key STRING, pass STRING, block STRING"
WORD_BPE, BYTE_BPE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sentence(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Odd documents: null, empty, blank, repeated, very long, near copies, and columns whose names operators use themselves."""
    r = random.Random(3)
    base = sentence(r, 400)
    near = base.split()
    near[200] = "other"
    texts = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (3, "one", "b"), (4, "One\x0btwo", "b"), (5, base, "a"), (6, base.upper(), "a"),
             (7, " ".join(near), "c"), (7, " ".join(near), "c"), (None, base, None), (8, sentence(r, 9000), "a"), (9, "spam spam " * 60, "b"),
             (10, "x" * 5000, "c"), (11, "line a\nline b\nline a\n" + sentence(r, 60), "c"), (12, "one", "a")]
    texts += [(20 + i, sentence(r, r.randint(20, 200)), r.choice("abc")) for i in range(40)]
    return [(i, t, "en", s, len(t or ""), "p", "n", "k", "x", "b") for i, t, s in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id LONG, quality INT, toxic INT"


# 1. Packing

def test_pieces_and_places(docs, rows):
    out = packing.pack_documents(docs, WORD_BPE, capacity=512, with_ids=True).collect()
    plain = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), 512)):
            own = ids[start:start + 512]
            want[doc_id, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert max(held.values()) <= 512


def test_packing_without_documents(none):
    assert packing.pack_documents(none, WORD_BPE).collect() == []


def fewest(lengths, capacity):
    """Fewest sequences by trying everything."""
    best = [len(lengths)]

    def go(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for i, room in enumerate(bins):
            if room >= rest[0] and room not in bins[:i]:
                go(rest[1:], [*bins[:i], room - rest[0], *bins[i + 1:]])
        go(rest[1:], [*bins, capacity - rest[0]])

    go(sorted(lengths, reverse=True), [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_is_optimal_on_small_counts(seed):
    r = random.Random(seed)
    lengths = [r.randint(3, 60) for _ in range(r.randint(1, 11))]
    patterns = packing.bin_completion(dict(Counter(lengths)), 100)
    assert Counter(x for p, n in patterns for x in p * n) == Counter(lengths)
    assert all(sum(p) <= 100 for p, _ in patterns)
    assert sum(n for _, n in patterns) == fewest(lengths, 100) >= packing.waste_bound(dict(Counter(lengths)), 100)


def test_bin_completion_beats_best_fit():
    counts = dict(Counter([44, 24, 24, 22, 21, 17, 8, 8, 6, 6]))  # fills 3 of 60 only in one way or so
    assert sum(n for _, n in packing.bin_completion(counts, 60)) == fewest(list(Counter(counts).elements()), 60)


# 2. WARC

def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 700)
    monkeypatch.setattr(warc, "FILE_BYTES", 9000)
    trap = warc.page_record(99, "u", "inner", None).decode() * 8
    pages = [(1, "http://a/\r\nx", "é" * 600), (2, None, "é" * 600), (3, "u", None), (4, "u", ""), (5, "u", trap), (6, "u", trap),
             (7, "u", "WARC/1.0\r\n" * 100), (None, "u", "é" * 600), (8, "u" * 3000, "short"), (9, "u", "short"), (2, None, "é" * 600)]
    df = spark.createDataFrame(pages, "page_id LONG, url STRING, html STRING")
    out = warc.read_archives(warc.write_archives(df, scratch_dir(spark, "warc")))
    top = {"é" * 600: 2, trap: 6, "WARC/1.0\r\n" * 100: 7}
    want = Counter()
    for page_id, _, html in pages:
        body = (html or "").encode()
        refers = top.get(html) if page_id is not None and page_id != top.get(html) else None
        want[page_id, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers,
             None if refers is not None else body] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in out.collect()) == want


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id LONG, url STRING, html STRING")
    assert warc.round_trip(empty, scratch_dir(spark, "warc")).collect() == []


# 3. HTML

@pytest.fixture(scope="module")
def field():
    return html_extraction.trained()


def test_held_out_pages(field):
    right = wrong = 0
    for page in labelled_pages(150, seed=1234):
        found = blocks(page)
        for got, block in zip(field.decode(html_extraction.features(found)), found, strict=True):
            right, wrong = right + (got == block.marked), wrong + (got != block.marked)
    assert wrong < 0.02 * (right + wrong)


def test_viterbi_is_the_best_labelling(field):
    page = html_extraction.features(blocks(labelled_pages(3, seed=5)[2]))[:9]

    def score(labels):
        emit = sum(sum(field.weights.get(f, 0) for f in own) for own, y in zip(page, labels) if y)
        return emit + sum(field.steps[int(a), int(b)] for a, b in zip(labels, labels[1:]))

    every = [[bool(k >> i & 1) for i in range(len(page))] for k in range(1 << len(page))]
    assert score(field.decode(page)) == pytest.approx(max(map(score, every)))


def test_main_text(spark, field):
    page = ('<html><head><title>T</title><script>var t="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
            '<div class="ad">Buy this now. It is cheap.</div><article><h1>A &amp; B</h1><p><b>First  line\n of it, which goes on.<br><p>Second&nbsp;one '
            'is here, too &lt;x&gt;.</p><!-- <p>hidden</p> --></article><footer>&copy; us &middot; All rights.</footer></body></html>')
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "< <p <a b='>'"), (1, "u", page), (4, "u", "<div>" * 3000)]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    out = html_extraction.extract(df, field).collect()
    want = "A & B\nFirst line of it, which goes on.\nSecond one is here, too <x>."
    assert [(r.page_id, r.text) for r in out if r.page_id in (1, 2, 3)] == [(1, want), (2, ""), (3, ""), (1, want)]
    assert all(r.n_chars == len(r.text) for r in out) and len(out) == 6
    assert html_extraction.extract(df.limit(0), field).collect() == []


# 4. Quality

def plain_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_quality_counts(docs, rows, spark):
    labels = spark.createDataFrame([], LABELS)
    out = quality.quality(docs, labels).collect()
    assert Counter(tuple(r) for r in out) == Counter((d[0], *plain_counts(d[1]), not plain_counts(d[1])[-1]) for d in rows)


def test_cutoffs_keep_their_bound(spark):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        text = " ".join((w + "###") if bad and r.random() < 0.8 else w for w in sentence(r, 40).split())
        docs.append((i, text, "en" if i % 2 else None))
        labels.append((i, int(not bad), 0))
    labels += [(None, 1, 0), (5, None, 0), (99999, 1, 0), (0, 0, 1), (0, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING, lang STRING")
    known = spark.createDataFrame(labels, LABELS)
    out = {x.doc_id: x.kept for x in quality.quality(df, known).collect()}
    good = [i for i in range(3000) if i % 5]
    assert sum(not out[i] for i in good) <= 0.01 * len(good)
    assert sum(out[i] for i in range(0, 3000, 5)) < 30
    kept = quality.kept_documents(df, known)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, k in out.items() if k}
    assert quality.kept_documents(df.limit(0), known).collect() == []


def test_binomial_tail(spark):
    from math import comb
    cases = [(10, 0), (500, 1), (2000, 7), (2000, 30)]
    df = spark.createDataFrame(cases, "n LONG, k LONG")
    got = [x[0] for x in df.orderBy("n", "k").select(quality.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect()]
    want = [1.0 if k >= n * 0.01 and k else sum(comb(n, i) * 0.01**i * 0.99**(n - i) for i in range(k + 1)) for n, k in cases]
    assert got == pytest.approx(want, rel=1e-9)


# 5. Search

def test_search(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([0.0, 0.0, r.uniform(-1, 1)]) for _ in range(r.choice([5, 8, 8]))]) for i in range(150)]
    rows += [(200, None), (220, [1.0, None]), (240, [float("nan")]), (260, [float("inf")]), (280, []), (None, [1.0] * 8), (3, rows[3][1]), (300, rows[4][1])]
    out = topk.search_every(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>"), k=7).collect()
    good = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert sorted(map(tuple, out)) == sorted(want)
    assert topk.search_every(spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>")).collect() == []


# 6. Mixing

def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        for s in over or free:
            out[s] = 2 * sizes[s] if over else level * weight[s]
        left -= sum(out[s] for s in over)
        free = free - set(over) if over else set()
    return out


def test_mixing(docs, rows):
    mix = mixing.Mix(block=16, shard=32)
    out = mixing.mixed(docs, mix).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d[0], len(words(d[1]))) for d in rows)
    sizes = Counter()
    for d in rows:
        sizes[d[3]] += len(words(d[1]))
    targets = plain_targets(sizes)
    taken = Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
    for source, size in sizes.items():
        assert all(r.target == pytest.approx(targets[source]) for r in out if r.source_size == size)
        assert taken[size] == round(targets[source])
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs.repartition(7), mix).collect()))


def test_mixed_documents(docs, rows):
    mix = mixing.Mix(block=16, shard=32)
    out = mixing.mixed_documents(docs, mix)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] += len(words(r.text))
    want = Counter()
    for r in mixing.mixed(docs, mix).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def test_shard_counts_sum_up(docs):
    mix = mixing.Mix(block=16, shard=32)
    _, sources = mixing.streamed(docs, mix)
    slots = mixing.placed(sources, mix).collect()
    need = {r.no: r.n_slots for r in sources.collect()}
    assert Counter(s.no for s in slots) == +Counter(need)
    assert {(s.no, s.j) for s in slots} == {(no, j) for no, n in need.items() for j in range(n)}
    assert max(Counter(s.shard for s in slots).values()) <= 32


def test_nothing_to_mix(none):
    assert mixing.mixed(none).collect() == [] and mixing.mixed_documents(none).collect() == []


# 7. Near-duplicates

def shingles(text):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min((x for x in (doc_id, least.get(find(i))) if x is not None), default=None)
    return Counter((d, len(s), d if not s else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_near_duplicates(docs, rows):
    out = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == plain_components([d[:2] for d in rows])
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in out)
    stays = near_dedup.distinct_documents(docs)
    groups = {(r.component_id if r.n_shingles else (r.doc_id, "own")) for r in out}
    assert stays.columns == docs.columns and stays.count() == len(groups)


def test_large_group_about_the_threshold(spark):
    r = random.Random(4)
    base = sentence(r, 300).split()
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(300)] = f"w{r.random()}"
        rows.append((i, " ".join(own)))
    near = near_dedup.Near(chunk=16, shingles=3000)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING"), near).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == plain_components(rows)


def test_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    shared, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    x, y, tiny = near_dedup.sketches([np.concatenate((shared, a)), np.concatenate((shared, b)), shared[:1]], 1000)
    assert abs((x == y).mean() - 0.6) < 0.07
    assert (tiny < np.uint64(1 << 63)).all()  # every coordinate is filled


def test_no_documents_to_link(none):
    assert near_dedup.near_duplicates(none).collect() == []


# 8. Scoring

def test_scores(docs, rows, spark):
    labels = [(i, 1, 0) for i in range(20, 40)] + [(20, 1, 0), (41, 0, 0), (42, 1, 1), (None, 1, 0), (43, None, None)]
    out = lm_scoring.scores(docs, spark.createDataFrame(labels, LABELS)).collect()

    def grams(text):
        data = b"\0\0\0" + (text or "").encode()
        return [data[i:i + 4] for i in range(len(data) - 3)]

    target, every, tc, ec = Counter(), Counter(), Counter(), Counter()
    for doc_id, text, *_ in rows:
        for g in grams(text):
            every[g] += 1
            ec[g[:3]] += 1
            if doc_id is not None and 20 <= doc_id < 40:
                target[g] += 1
                tc[g[:3]] += 1
    want = []
    for doc_id, text, *_ in rows:
        g = grams(text)
        loss = [(-np.log2((target[x] + 0.125) / (tc[x[:3]] + 32)), -np.log2((every[x] + 0.125) / (ec[x[:3]] + 32))) for x in g]
        want.append((doc_id, len(g), round(float(np.mean([b - t for t, b in loss])), 6) if g else None))
    assert Counter((r.doc_id, r.n_tokens, None if r.score is None else round(r.score, 6)) for r in out) == Counter(want)


def test_nothing_to_score(none, spark):
    assert lm_scoring.scores(none, spark.createDataFrame([], LABELS)).collect() == []


# 9. Files of ids

def test_ids_round_trip(docs, rows, spark):
    out = sorted(token_binary.token_files(docs, scratch_dir(spark, "ids"), BYTE_BPE).collect(), key=lambda r: r.start)
    plain, start = Tokenizer.from_file(BYTE_BPE), 0
    for r, (doc_id, text, *_) in zip(out, sorted(rows, key=lambda d: (d[0] is not None, d[0] or 0)), strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_no_ids(none, spark):
    assert token_binary.token_files(none, scratch_dir(spark, "ids"), BYTE_BPE).collect() == []


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = token_binary.pack(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8 and (token_binary.unpack(data, bits, 1001) == ids).all()


def test_random_access(tmp_path):
    r = np.random.default_rng(5)
    docs = [(i if i % 3 else None, r.integers(0, 1 << 17, r.integers(0, 40), dtype=np.uint32)) for i in range(50)]
    with open(tmp_path / "x", "wb") as stream:
        writer = token_binary.Writer(stream, 17, block=16)
        for doc_id, ids in docs:
            writer.add(doc_id, ids)
        writer.close()
    with open(tmp_path / "x", "rb") as file:
        reader = token_binary.Reader(file, (tmp_path / "x").stat().st_size)
        every = np.concatenate([ids for _, ids in docs])
        for a, b in ((0, 0), (3, 17), (15, 33), (0, len(every))):
            assert (reader.ids(a, b) == every[a:b]).all()
        assert [(i, x.tolist()) for i, x in reader.documents(30)] == [(i, x.tolist()) for i, x in docs]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_chunked_ids_are_the_library_s(path):
    r = random.Random(6)
    parts = [*" \n\t\r\x0b\x1c\x1f\x85\xa0 　ab1Z's!.,$é́İΣσ日\x00\x01ﬁ", "<|endoftext|>", "  ", "\n\n", " the", "'ll", "Don't. "]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(3000)] + ["", None]
    coder, out = Encoder(path), []
    for ids, n in coder.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert out == [e.ids for e in coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


# 10. Tool calls

def test_tool_calls(spark):
    calls = [(1, "a", 0, "search", '{"limit":3,"query":"x"}', None), (1, "b", 2, "lookup", '{"key":"é"}', "c"), (1, "c", 4, "lookup", '{"key":1}', "a"),
             (1, "c", 5, "lookup", '{"key":"late"}', None), (2, "a", 0, "lookup", "no", "b"), (2, "b", 1, "none", None, "a"), (2, "d", 1, "search", "[]", "a"),
             (3, "a", 0, "calculate", '{"digits":true,"expression":"1","z":0}', "gone"), (None, "a", 0, "lookup", '{"key":"k"}', None)]
    calls += [(4, f"k{i}", i, "lookup", '{"key":"k"}', f"k{i + 1}" if i < 40 else None) for i in range(41)]
    results = [(1, "a", 1, "r"), (1, "a", 3, "again"), (9, "a", 1, "lost"), (1, "c", 6, None)]
    out = tool_calls.link(spark.createDataFrame(calls, "conv_id LONG, call_id STRING, turn LONG, name STRING, arguments STRING, after STRING"),
                          spark.createDataFrame(results, "conv_id LONG, call_id STRING, turn LONG, content STRING"), tool_calls.SCHEMAS).collect()
    got = {(r.conv_id, r.call_id, r.turn): r for r in out}
    assert len(out) == len(calls) + 2
    assert [(got[k].status, got[k].depth, got[k].position) for k in ((1, "a", 0), (1, "c", 4), (1, "b", 2), (1, "c", 5))] == [
        ("linked", 0, 1), ("linked", 1, 2), ("open", 2, 3), ("repeated", None, None)]
    assert {got[2, x, t].status for x, t in (("a", 0), ("b", 1), ("d", 1))} == {"circular"}
    assert (got[9, "a", 1].status, got[1, "a", 3].status, got[3, "a", 0].depth, got[4, "k0", 0].depth) == ("orphan", "repeated", 0, 40)
    assert got[1, "a", 0].json == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","result":"r"}'
    assert got[1, "b", 2].errors == [] and got[1, "c", 4].errors == ["key is no string"]
    assert got[3, "a", 0].errors == ["digits is no integer", "unexpected z"] and got[2, "a", 0].errors == ["no JSON"]
    assert got[2, "d", 1].errors == ["no object"] and got[2, "b", 1].errors == ["unknown tool"]


def test_turns(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, "user", "r"), (1, 3, "Assistant", "x" * 9), (2, 0, "system", None), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(turns, "conv_id LONG, turn LONG, role STRING, text STRING")
    out = {(r.conv_id, r.turn): (r.status, r.depth) for r in tool_calls.linked_conversations(df).collect()}
    assert out == {(1, 1): ("linked", 0), (1, 3): ("open", 1), (None, 1): ("open", 0)}
    assert tool_calls.linked_conversations(df.limit(0)).collect() == []
