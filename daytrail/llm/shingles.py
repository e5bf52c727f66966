"""Word shingles of whole texts as sets of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of each word with A-Z lowered, number of words of each text)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    full = pc.not_equal(pc.binary_length(parts.values), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(full)))[parts.offsets.to_numpy()]
    coded = parts.values.dictionary_encode()
    prints = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return prints[coded.indices.to_numpy()[full]], np.diff(upto)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per text the ascending fingerprints of its distinct shingles of `width` words.

    A shorter text has one, of all its words; a text without words, or null, has none.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        words, counts = _words(pa.concat_arrays([texts.slice(at, to - at)]))
        runs = words[:max(len(words) - width + 1, 0)].copy()
        for k in range(1, width):
            runs = runs * _ODD + words[k:k + len(runs)]
        runs = mixed_bits(runs)
        start = 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(runs[start:start + n - width + 1])
            elif n:
                yield np.array([xxhash.xxh3_64_intdigest(words[start:start + n].tobytes(), seed=n)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            start += n
        at = to
