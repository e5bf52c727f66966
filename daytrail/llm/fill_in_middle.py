"""Fill-in-the-middle documents whose cuts are found by memoized content-defined chunks.

A token is a run of letters A-Z, a-z or any other single character. Cuts are named by tokens, while documents are bytes. A
rolling hash over the last 16 bytes ends a chunk wherever it meets a fixed pattern, so that equal passages fall into equal chunks
wherever they stand. What a chunk adds to a count is a boundary summary: the tokens that start in it if the character before
is no letter, its characters, and whether its first and last bytes are letters. Summaries are kept in a cache of
bounded bytes by the chunk's own bytes, so a hit is a comparison of content, and shared passages are counted once in a
worker. Two chunks combine by adding their counts, less one where a run of letters goes over their border. Running sums of
the combined counts say in which chunk a cut lies; only that chunk is then looked at byte by byte.

Rules: a null text is empty. An empty text, one that holds a sentinel, and the share of documents that the third draw leaves
out stay plain. Draws come from `1:` and the decimal doc_id, so equal ids have equal draws; a null doc_id draws from `1:`. Rows that
are equal come out as often as they came. Long texts are chunked in slices. Bytes that are no UTF-8 count as
characters by the same rule (all but 10xxxxxx). Other columns are left out. No documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.llm.shingles import mixed_bits

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= ord("a")) & ((_BYTES | 32) <= ord("z"))
_CHARACTER = (_BYTES & 0xC0) != 0x80
_NOISE = mixed_bits(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Fim:
    """`rate`: documents of a hundred that are transformed; `spm`: of those, suffix first. Sizes are in bytes."""

    seed: int = 1
    rate: int = 90
    spm: int = 20
    window: int = 16
    mean_chunk: int = 512
    longest_chunk: int = 8192
    slice: int = 1 << 20
    cache: int = 64 << 20


def starts(data: np.ndarray, after_letter: bool = False) -> np.ndarray:
    """Where tokens start in UTF-8 bytes."""
    letter = _LETTER[data]
    before = np.concatenate(([after_letter], letter[:-1]))
    return np.flatnonzero(np.where(letter, ~before, _CHARACTER[data]))


def chunk_ends(data: np.ndarray, fim: Fim = Fim()) -> np.ndarray:
    """Ends of the chunks; whether a chunk ends at a byte is a matter of the `window` bytes up to it, save at the longest size."""
    ends = []
    for at in range(0, len(data), fim.slice):
        held = data[max(0, at - fim.window + 1):at + fim.slice]
        rolled, width = _NOISE[held], 1
        while width < fim.window:  # the hash of twice as many bytes from two neighbours
            rolled = rolled[:-width] * np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + rolled[width:]
            width *= 2
        place = np.flatnonzero((rolled >> np.uint64(32)) % np.uint64(fim.mean_chunk) == 0)
        ends.append(place + max(0, at - fim.window + 1) + fim.window)
    cuts = np.unique(np.concatenate([np.zeros(1, np.int64), *ends, np.array([len(data)])]))
    gaps = np.diff(cuts)
    for i in np.flatnonzero(gaps > fim.longest_chunk)[::-1]:
        cuts = np.insert(cuts, i + 1, np.arange(cuts[i] + fim.longest_chunk, cuts[i + 1], fim.longest_chunk))
    return cuts[1:]


class Summaries:
    """Boundary summaries of chunks by their bytes, in two generations of at most `most` bytes each."""

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.new: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.hits = self.misses = 0

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        """(tokens, characters, first byte is a letter, last byte is a letter)."""
        found = self.new.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        found = self.old.get(chunk)
        if found is None:
            self.misses += 1
            data = np.frombuffer(chunk, np.uint8)
            found = (len(starts(data)), int(_CHARACTER[data].sum()), bool(_LETTER[data[0]]), bool(_LETTER[data[-1]]))
        else:
            self.hits += 1
        self.new[chunk] = found
        self.held += len(chunk) + 200
        if self.held > self.most:
            self.old, self.new, self.held = self.new, {}, 0
        return found


@lru_cache(maxsize=2)
def _summaries(most: int) -> Summaries:
    """One for each worker process, so that what it has seen serves later tasks."""
    return Summaries(most)


class Counted:
    """A text's chunks with running counts; `place` finds the byte and character at which a token starts."""

    def __init__(self, text: bytes, fim: Fim, cache: Summaries):
        self.data = np.frombuffer(text, np.uint8)
        self.ends = chunk_ends(self.data, fim)
        self.begins = np.concatenate(([0], self.ends[:-1]))
        of = [cache.of(text[a:b]) for a, b in zip(self.begins.tolist(), self.ends.tolist())]
        tokens, characters, first, last = (np.array(x) for x in zip(*of)) if of else ([np.zeros(0, np.int64)] * 4)
        self.joined = np.concatenate(([False], (last[:-1] & first[1:]).astype(bool))) if of else np.zeros(0, bool)
        self.tokens = np.concatenate(([0], np.cumsum(tokens - self.joined)))
        self.characters = np.concatenate(([0], np.cumsum(characters)))

    @property
    def n(self) -> int:
        return int(self.tokens[-1])

    def place(self, token: int) -> tuple[int, int]:
        if token == self.n:
            return len(self.data), int(self.characters[-1])
        k = int(np.searchsorted(self.tokens, token, "right")) - 1
        chunk = self.data[self.begins[k]:self.ends[k]]
        at = int(starts(chunk, bool(self.joined[k]))[token - self.tokens[k]])
        return int(self.begins[k]) + at, int(self.characters[k]) + int(_CHARACTER[chunk[:at]].sum())


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def transform(doc_id: int | None, text: bytes, fim: Fim, cache: Summaries) -> tuple[int, str, bytes, int | None, int | None]:
    """(tokens, form, output, characters of the prefix, of the middle)."""
    counted = Counted(text, fim, cache)
    h = draws(doc_id, fim.seed)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or h[2] % 100 >= fim.rate or p in text or s in text or m in text:
        return counted.n, "plain", text, None, None
    low, high = sorted(x % (counted.n + 1) for x in h[:2])
    (a, a_chars), (b, b_chars) = counted.place(low), counted.place(high)
    before, middle, after = text[:a], text[a:b], text[b:]
    if h[3] % 100 < fim.spm:
        form, output = "spm", b"".join((s, after, p, before, m, middle))
    else:
        form, output = "psm", b"".join((p, before, s, after, m, middle))
    return counted.n, form, output, a_chars, b_chars - a_chars


def fill_in_middle(docs: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _summaries(fim.cache)
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                out.append((doc_id, *transform(doc_id, text.as_py() or b"", fim, cache)))
                held += len(out[-1][3])
                if held > 8 << 20:
                    yield rows(out)
                    out, held = [], 0
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        ids, n, form, text, prefix, middle = zip(*out) if out else [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
             pa.array(middle, pa.int64()), pa.array(text, pa.binary())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    made = own.mapInArrow(run, "doc_id LONG, n LONG, form STRING, prefix_chars LONG, middle_chars LONG, output BINARY")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. It holds no sentinel, and none can come about across a border, as only a sentinel's first
    character is `<`; so each sentinel is where it is found first."""
    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, left, -1), right, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """What `fill_in_middle` makes, with digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs, fim)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (
    SELECT *, len(u) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
           CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
    SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
           array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
