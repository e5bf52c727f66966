"""Removal of later copies of long passages by longest-previous-factor arrays over suffixes in order.

For a position i of a document, the longest previous factor LPF[i] is the longest string at i that also starts in a document with a smaller
doc_id. In suffix order it is reached at one of two neighbours: the nearest suffix before i, or after i, of a smaller document
(previous and next smaller position). All bytes of a factor of at least `least` bytes go; the first document to have it keeps it.

A suffix array of all text is not needed for that. Suffixes that share `least` bytes share the window of that many bytes they start
with, so suffixes may be dealt over tasks by anything the window determines. That is its anchor here: the least of the hashes of
the 16-byte strings in it, the first of equals. Neighbouring windows mostly have the same anchor and travel as one stretch of text:
1. Blocks of documents send their distinct anchors, 8 bytes each, to buckets, which answer which of them another document has too;
   the rest cannot be in any factor. An anchor that very many stretches have is answered as crowded.
2. Blocks send each distinct stretch of a shared anchor once, with the smallest document of the block that has it, to the bucket of
   its anchor; at crowded anchors the windows go one by one to buckets of their own. A bucket puts all suffixes
   that start with a window in order, makes the LPF array and answers with one bit a window. Of equal stretches one stands in the order, with
   the smallest document; where another is later, it is a factor as a whole.
3. Blocks join the factors of each document.
Blocks and buckets meet in groups of bounded size: `rows` documents or one long text; `bucket` bytes of text in the mean, of which at most
`slice` suffixes are in order at a time. A passage that a third of all documents have is one stretch a block.

Rules: a null text is empty; texts below `least` bytes lose nothing. A null doc_id is neither smaller nor larger than any: such rows lose nothing
and take nothing from others; nor do rows of one doc_id from each other. Equal rows have equal results. No documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrail.llm.common import addressed, rereadable
from daytrail.llm.shingles import mixed_bits

ANCHOR = 16
TILE = 1 << 15
_NOISE = mixed_bits(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Repeats:
    """`least`: bytes of a factor, 50 to 79; `crowded`: stretches of one anchor beyond which windows go one by one."""

    least: int = 50
    rows: int = 512
    long: int = 256 << 10
    bucket: int = 16 << 20
    crowded: int = 1 << 15
    slice: int = 1 << 20


def lpf(text: np.ndarray, at: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """LPF, up to `least`, of the suffixes of `text` at `at`, each at least that long, of the documents `doc`."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    offsets = [*range(0, least - 7, 8)]
    if least % 8:
        offsets.append(least - 8)  # reaches back into the word before it
    keys = [words[at + k].astype(np.uint64) for k in offsets]
    order = np.lexsort(keys[::-1])
    doc, keys = doc[order], [k[order] for k in keys]
    out = np.zeros(len(at), np.int64)
    for near in (smaller(doc), len(at) - 1 - smaller(doc[::-1])[::-1]):
        mine = np.flatnonzero((near >= 0) & (near < len(at)))
        out[mine] = np.maximum(out[mine], common(keys, offsets, mine, near[mine], least))
    back = np.empty_like(out)
    back[order] = out
    return back


def smaller(doc: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller number, or -1.

    All that still look hop at once, each to where its present place looks; what is hopped over is as large or larger. Few that are
    left, behind long descents, go on one by one.
    """
    near = np.arange(-1, len(doc) - 1)
    wrong = np.flatnonzero(near >= 0)
    wrong = wrong[doc[near[wrong]] >= doc[wrong]]
    while len(wrong) > 64:
        near[wrong] = near[near[wrong]]
        wrong = wrong[near[wrong] >= 0]
        wrong = wrong[doc[near[wrong]] >= doc[wrong]]
    for i in wrong.tolist():
        k = int(near[i])
        while k >= 0 and doc[k] >= doc[i]:
            k = int(near[k])
        near[i] = k
    return near


def common(keys: list[np.ndarray], offsets: list[int], a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Bytes that the suffixes `a` and `b` have in common, up to `least`."""
    out = np.full(len(a), least, np.int64)
    same = np.arange(len(a))
    for key, offset in zip(keys, offsets):
        differ = key[a[same]] ^ key[b[same]]
        end = same[differ != 0]
        bits = differ[differ != 0]
        equal = np.zeros(len(end), np.int64)
        for k in range(1, 8):  # leading bytes without a difference
            equal += bits < np.uint64(1 << (64 - 8 * k))
        out[end] = offset + equal
        same = same[differ == 0]
    return out


def anchored(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: (first window, first window after it, hash of the anchor)."""
    n, wide = len(data) - least + 1, least - ANCHOR + 1
    firsts, places, hashes = [], [], []
    for at in range(0, max(n, 0), TILE):
        h, width = _NOISE[data[at:at + TILE + least - 1]], 1
        while width < ANCHOR:
            h = h[:-width] * np.uint64(pow(_ODD, width, 1 << 64)) + h[width:]
            width *= 2
        low = (h & ~np.uint64(0xFFFF)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= wide:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:len(low) - (wide - width)], low[wide - width:])
        place = (low & np.uint64(0xFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        firsts.append(first + at), places.append(place[first] + at), hashes.append(h[place[first]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, place, h = map(np.concatenate, (firsts, places, hashes))
    new = np.concatenate(([True], place[1:] != place[:-1]))
    first, h = first[new], mixed_bits(h[new])
    return first, np.append(first[1:], n), h


class Block:
    """Documents of a block in ascending order, their bytes one after another, and the runs within them."""

    def __init__(self, table: pa.Table, repeats: Repeats):
        ids, texts, rows = (table[c].to_pylist() for c in ("doc_id", "text", "row"))
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, rows[i]))
        self.ids = [ids[i] for i in self.order]
        self.texts = [texts[i] or b"" for i in self.order]
        least = repeats.least
        self.taken = [i for i, t in enumerate(self.texts) if len(t) >= least and self.ids[i] is not None]
        sizes = np.array([len(self.texts[i]) for i in self.taken], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.text = b"".join(self.texts[i] for i in self.taken)
        first, after, self.hash = anchored(np.frombuffer(self.text, np.uint8), least)
        # A run meets windows of one document at most, as a border makes more windows void than a run can have.
        doc = np.searchsorted(self.start, first, "right") - 1
        late = first > self.end[doc] - least if len(doc) else np.zeros(0, bool)
        doc = doc + late
        fits = doc < len(self.taken)
        first, after, self.hash, doc = first[fits], after[fits], self.hash[fits], doc[fits]
        first = np.maximum(first, self.start[doc])
        after = np.minimum(after, self.end[doc] - least + 1)
        full = first < after
        self.first, self.after, self.hash, self.doc = first[full], after[full], self.hash[full], doc[full]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, whether several rows have it, stretches as a power of two)."""
        order = np.argsort(self.hash, kind="stable")
        h, doc = self.hash[order], self.doc[order]
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(h)))
        several = np.maximum.reduceat(doc, new) != np.minimum.reduceat(doc, new) if len(h) else np.zeros(0, bool)
        return h[new], several, np.log2(n).astype(np.uint8) if len(n) else np.zeros(0, np.uint8)

    def stretches(self, state: np.ndarray, repeats: Repeats) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """What goes to the buckets: ([(key, text, windows, smallest document)], and for each occurrence its number, first window, document).

        `state`: of each distinct hash in order, 0 alone, 1 shared, 2 crowded.
        """
        distinct = np.unique(self.hash)
        of = state[np.searchsorted(distinct, self.hash)] if len(distinct) else np.zeros(0, np.uint8)
        sent: dict[bytes, int] = {}
        out: list[tuple] = []
        which, at, docs = [], [], []
        text, least = self.text, repeats.least
        take = np.flatnonzero(of)
        rows = (x[take].tolist() for x in (of, self.first, self.after, self.doc, self.hash))
        for kind, a, b, doc, anchor in zip(*rows):
            for p, q in ((a, b),) if kind == 1 else zip(range(a, b), range(a + 1, b + 1)):
                held = text[p:q + least - 1]
                k = sent.setdefault(held, len(out))
                if k == len(out):
                    # Equal windows have equal anchors, and are all sent in stretches or all alone.
                    key = anchor if kind == 1 else int.from_bytes(hashlib.blake2b(held, digest_size=8).digest(), "little")
                    out.append((key, held, q - p, doc))
                which.append(k), at.append(p), docs.append(doc)
        return out, np.array(which, np.int64), np.array(at, np.int64), np.array(docs, np.int64)


def _bits(found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit number for each stretch from a flag for each window."""
    end = np.cumsum(n)
    within = np.arange(len(found)) - np.repeat(end - n, n)
    value = found.astype(np.uint64) << within.astype(np.uint64)
    return np.add.reduceat(value, end - n) if len(n) else np.zeros(0, np.uint64)


def earlier(texts: list[bytes], n: np.ndarray, doc: np.ndarray, key: np.ndarray, repeats: Repeats) -> np.ndarray:
    """Of each stretch, the windows with a factor in a smaller document, as bits."""
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
    distinct = list(number)
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, which, doc)
    one = np.zeros(len(distinct), np.int64)
    one[which] = np.arange(len(texts))
    windows, keys = n[one], key[one]
    bits = np.zeros(len(distinct), np.uint64)
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0))) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(order)))
    order = order[np.repeat(count > 1, count)]  # a stretch that is the only one of its anchor has no other suffix to meet
    at = 0
    upto = np.cumsum(windows[order])
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + repeats.slice, "right")))
        while to < len(order) and keys[order[to]] == keys[order[to - 1]]:  # an anchor's stretches stay together
            to += 1
        held = order[at:to]
        parts = [distinct[i] for i in held.tolist()]
        text = np.frombuffer(b"".join(parts), np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        m = windows[held]
        begin = np.repeat(np.cumsum(size) - size, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        found = lpf(text, begin, np.repeat(first[held], m), repeats.least) >= repeats.least
        bits[held] = _bits(found, m)
        at = to
    whole = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    return np.where(doc > first[which], whole, bits[which])


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys, in the order of keys)."""
    of = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1]))) if len(of) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
        yield int(of[order[a]]), order[a:b]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_KEY = [("file", pa.int64()), ("block", pa.int64()), ("bucket", pa.int64())]
_ANCHORS = pa.schema([*_KEY, ("hashes", pa.binary()), ("several", pa.binary()), ("powers", pa.binary())])
_STRETCHES = pa.schema([*_KEY, ("keys", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary()), ("text", pa.binary())])
_ANSWERS = pa.schema([*_KEY, ("kind", pa.int32()), ("answer", pa.binary())])
_DONE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                   ("kept", pa.binary())])
_DDL = {"LONG": pa.int64(), "INT": pa.int32(), "BINARY": pa.binary()}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {next(k for k, v in _DDL.items() if v == f.type)}" for f in schema)


def _array(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(data, kind)


def shared_anchors(table: pa.Table, repeats: Repeats) -> pa.Table:
    """Answers of a bucket of anchors: a byte for each hash, 0 alone, 1 shared, 2 crowded."""
    parts = [_array(x, np.uint64) for x in table["hashes"].to_pylist()]
    several = np.concatenate([_array(x, np.uint8) for x in table["several"].to_pylist()])
    power = np.concatenate([_array(x, np.uint8) for x in table["powers"].to_pylist()])
    distinct, which, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = (n > 1) | (np.bincount(which, several, len(distinct)) > 0)
    stretches = np.bincount(which, 2.0 ** power, len(distinct))
    state = np.where(shared, np.where(stretches > repeats.crowded, 2, 1), 0).astype(np.uint8)[which]
    ends = np.cumsum(list(map(len, parts)))
    rows = [(f, b, k, 0, state[e - len(p):e].tobytes()) for f, b, k, p, e in
            zip(*(table[c].to_pylist() for c in ("file", "block", "bucket")), parts, ends)]
    return _table(rows, _ANSWERS)


def found_factors(table: pa.Table, repeats: Repeats) -> pa.Table:
    """Answers of a bucket of stretches: a 64-bit number of flags for each."""
    sizes = [_array(x, np.uint8) for x in table["sizes"].to_pylist()]
    n = np.concatenate(sizes).astype(np.int64)
    doc = np.concatenate([_array(x, np.int64) for x in table["docs"].to_pylist()])
    key = np.concatenate([_array(x, np.uint64) for x in table["keys"].to_pylist()])
    texts = []
    for data, windows in zip(table["text"].to_pylist(), sizes):
        ends = np.cumsum(windows.astype(np.int64) + repeats.least - 1).tolist()
        texts += [data[a:b] for a, b in zip([0, *ends], ends)]
    bits = earlier(texts, n, doc, key, repeats)
    ends = np.cumsum(list(map(len, sizes)))
    rows = [(f, b, k, 1, bits[e - len(s):e].tobytes()) for f, b, k, s, e in
            zip(*(table[c].to_pylist() for c in ("file", "block", "bucket")), sizes, ends)]
    return _table(rows, _ANSWERS)


def _answered(parts: Iterator[tuple[int, np.ndarray]], answers: pa.Table, kind: int, dtype, n: int) -> np.ndarray:
    """Answers put back into the order of what was sent."""
    of = {b: a for b, k, a in zip(*(answers[c].to_pylist() for c in ("bucket", "kind", "answer"))) if k == kind}
    out = np.zeros(n, dtype)
    for bucket, places in parts:
        out[places] = _array(of[bucket], dtype)
    return out


def repeats_removed(docs: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """(doc_id, file, row, n_bytes, n_removed, n_spans, kept): `kept` are the bytes left, a row a document."""
    text = F.col("text").cast("string").cast("binary")
    long = F.coalesce(F.octet_length(text), F.lit(0)) > repeats.long
    rows = addressed(rereadable(docs), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), long.alias("long"))
    block = F.when(F.col("long"), -1 - F.col("__row")).otherwise(F.floor(F.col("__row") / repeats.rows))
    own = rows.select("doc_id", "text", F.col("__file").alias("file"), F.col("__row").alias("row"), block.alias("block"))
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = int(n_bytes // repeats.bucket) + 1

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        h, several, power = Block(table, repeats).anchors()
        return _table([(key[0].as_py(), key[1].as_py(), k, h[i].tobytes(), several[i].astype(np.uint8).tobytes(), power[i].tobytes())
                       for k, i in _dealt(h, buckets)], _ANCHORS)

    def sent(block: Block, answers: pa.Table) -> tuple:
        distinct = np.unique(block.hash)
        state = _answered(_dealt(distinct, buckets), answers, 0, np.uint8, len(distinct))
        out, which, at, doc = block.stretches(state, repeats)
        return out, which, at, doc, np.array([k for k, *_ in out], np.uint64)

    def send_stretches(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, repeats)
        out, *_, keys = sent(block, answers)
        ids = np.array([block.ids[block.taken[doc]] for *_, doc in out], np.int64)
        windows = np.array([n for _, _, n, _ in out], np.uint8)
        return _table([(key[0].as_py(), key[1].as_py(), k, keys[i].tobytes(), windows[i].tobytes(), ids[i].tobytes(),
                        b"".join(out[x][1] for x in i.tolist())) for k, i in _dealt(keys, buckets)], _STRETCHES)

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, repeats)
        out, which, at, doc, keys = sent(block, answers)
        bits = _answered(_dealt(keys, buckets), answers, 1, np.uint64, len(keys))
        n = np.array([x[2] for x in out], np.int64)
        ids = np.array([block.ids[i] for i in block.taken], np.int64)
        first = np.array([ids[x[3]] for x in out], np.int64)
        whole = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
        flags = np.where(ids[doc] > first[which], whole[which], bits[which]) if len(which) else np.zeros(0, np.uint64)
        return finished(block, [table["row"][i].as_py() for i in block.order], n[which] if len(which) else n, at, flags, repeats)

    blocks = own.groupBy("file", "block")
    asked = blocks.applyInArrow(send_anchors, _ddl(_ANCHORS))
    told = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: shared_anchors(t, repeats), _ddl(_ANSWERS))
    stretches = blocks.cogroup(told.groupBy("file", "block")).applyInArrow(send_stretches, _ddl(_STRETCHES))
    factors = stretches.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: found_factors(t, repeats), _ddl(_ANSWERS))
    return blocks.cogroup(told.unionByName(factors).groupBy("file", "block")).applyInArrow(finish, _ddl(_DONE))


def finished(block: Block, rows: list[int], n: np.ndarray, at: np.ndarray, flags: np.ndarray, repeats: Repeats) -> pa.Table:
    """Join the factors that start at the flagged windows, and take their bytes out."""
    change = np.zeros(len(block.text) + 1, np.int32)
    for k in range(int(n.max()) if len(n) else 0):
        start = at[(flags >> np.uint64(k)) & np.uint64(1) == 1] + k
        np.add.at(change, start, 1)
        np.add.at(change, start + repeats.least, -1)
    gone = np.cumsum(change[:-1]) > 0
    data = np.frombuffer(block.text, np.uint8)
    out, taken = [], dict(zip(block.taken, zip(block.start.tolist(), block.end.tolist())))
    for i, (doc_id, text) in enumerate(zip(block.ids, block.texts)):
        removed = spans = 0
        if i in taken:
            a, b = taken[i]
            mine = gone[a:b]
            removed = int(mine.sum())
            if removed:
                spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
                text = data[a:b][~mine].tobytes()
        out.append((doc_id, rows[i], len(block.texts[i]), removed, spans, text))
    return _table(out, _DONE)


def without_repeats(docs: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row a document."""
    return repeats_removed(docs, repeats).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (  -- two hexadecimal digits a byte
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
piece AS (SELECT r, doc_id, n, c, substr(h, 2 * c + 1, 610) AS h FROM (SELECT *, unnest(range(0, n - 49, 256)) AS c FROM t)),
w AS (
    SELECT r, doc_id, s, substr(h, 2 * (s - c) + 1, 100) AS g
    FROM (SELECT r, doc_id, h, c, unnest(range(c, least(c + 256, n - 49))) AS s FROM piece)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM w JOIN f USING (g) WHERE first < doc_id),
run AS (SELECT r, s, sum(CASE WHEN before IS NULL OR s > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS k FROM hit),
span AS (SELECT r, k, min(s) AS a, max(s) + 50 AS b FROM run GROUP BY r, k),
cut AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS from_here FROM span),
kept AS (
    SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
           string_agg(substr(h, 2 * from_here + 1, 2 * (a - from_here)), '' ORDER BY k) AS head FROM cut JOIN t USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""
