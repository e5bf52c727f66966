"""Token ids of whole texts by the `tokenizers` library, at the pace a corpus needs.

A public tokenizer splits a text before it looks for pieces, and never across a blank or line break
that follows another character than white space (byte-level kinds) or at all (kinds that drop white
space). So the ids of a text are those of its chunks, one after another, and a chunk that was seen
before needs no second call. Arrow splits texts and numbers the distinct chunks; numpy puts ids together.
Texts with other white space are cut by a plain pattern at the same places.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

# They bound what a worker holds while it encodes (a slice) and between its tasks (the chunks).
SLICE_BYTES = 2_000_000
CACHED_CHUNKS = 250_000
# White space as the byte-level pattern's \s has it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNKS = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
_ODD = f"[{BLANKS}][ \n]|\\x00"
_STOP = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])"  # a letter and a stop never share a piece of the pattern
_MARK = "\x01"


class Encoder:
    """Ids of many texts. Distinct chunks are kept in two generations of bounded size."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.keeps_space = "ByteLevel" == (json.load(file)["pre_tokenizer"] or {}).get("type")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if self.keeps_space:
            size = self.tokenizer.get_vocab_size()
            firsts = [(self.tokenizer.id_to_token(i) or "")[:1] for i in range(size)]
            self.opens = np.array([t in ("Ġ", "Ċ") for t in firsts])  # byte-level forms of blank and line break
        else:
            self.mark = self._plain([_MARK])[0]

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _unseen(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, many in one call where their ids can be told apart."""
        out: list[bytes | None] = [None] * len(chunks)
        if self.keeps_space:
            easy = [i for i, c in enumerate(chunks) if c[:1] in (" ", "\n") and c[-1].isalnum()
                    and c.rfind(" ") <= 0 and c.rfind("\n") <= 0 and not _CHUNKS.match(c[1:]).end() < len(c) - 1
                    and "<|" not in c]
        else:
            easy = [i for i, c in enumerate(chunks) if _MARK not in c]
        groups = [easy[k:k + 300] for k in range(0, len(easy), 300)]
        for group, ids in zip(groups, self._plain([self._joined([chunks[i] for i in g]) for g in groups]), strict=True):
            bounds = self._bounds(ids)
            if len(bounds) == len(group):
                data = ids.tobytes()
                for i, (start, end) in zip(group, bounds, strict=True):
                    out[i] = data[start:end]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._plain([chunks[i] for i in rest]), strict=True):
            out[i] = ids.tobytes()
        return out

    def _joined(self, chunks: list[str]) -> str:
        return "".join(chunks) if self.keeps_space else f" {_MARK} ".join(chunks)

    def _bounds(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Byte ranges of the joined chunks' ids."""
        if self.keeps_space:
            at = [*(np.flatnonzero(self.opens[ids]) * 4).tolist(), 4 * len(ids)]
            return list(zip(at, at[1:]))
        at = (np.flatnonzero(ids == self.mark[0]) * 4).tolist()
        return list(zip([0, *(x + 4 for x in at)], [*at, 4 * len(ids)], strict=True))

    def _ids(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.new.get, chunks))
        lost = [i for i, x in enumerate(found) if x is None]
        unseen = []
        for i in lost:
            found[i] = self.old.get(chunks[i])
            if found[i] is None:
                unseen.append(i)
        for i, ids in zip(unseen, self._unseen([chunks[i] for i in unseen]), strict=True):
            found[i] = ids
        for i in lost:
            self.new[chunks[i]] = found[i]
        if len(self.new) > CACHED_CHUNKS:
            self.old, self.new = self.new, {}
        return found

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All chunks in order, and how many each text has."""
        if not self.keeps_space:
            lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # the rest is lowered there
            apart = pc.replace_substring_regex(pc.replace_substring(lower, "\n", " "), _STOP, r"\1 \2")
            parts = pc.split_pattern(apart, " ")
            return parts.values, np.diff(parts.offsets.to_numpy())
        odd = pc.match_substring_regex(texts, _ODD)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        parts = pc.split_pattern(pc.replace_substring_regex(marked, _STOP, "\\1\0\\2"), "\0")
        if pc.any(odd).as_py():
            hard = odd.to_numpy(zero_copy_only=False)
            lists = [_CHUNKS.findall(t) if h else p for t, h, p in
                     zip(texts.to_pylist(), hard, parts.to_pylist(), strict=True)]
            parts = pa.array(lists, pa.list_(pa.string()))
        return parts.values, np.diff(parts.offsets.to_numpy())

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of the next texts one after another, number of ids of each); null texts have none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
            chunks, n_chunks = self._split(pa.concat_arrays([texts.slice(at, to - at)]))
            coded = chunks.dictionary_encode()
            ids = self._ids(coded.dictionary.to_pylist())
            flat = np.frombuffer(b"".join(ids), np.uint32)
            n_ids = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
            starts = np.cumsum(n_ids, dtype=np.int32) - n_ids
            which = coded.indices.to_numpy()
            n = n_ids[which]
            ends = np.cumsum(n, dtype=np.int64)
            places = np.repeat(starts[which] - (ends - n).astype(np.int32), n)
            places += np.arange(len(places), dtype=np.int32)
            bounds = np.concatenate(([0], np.cumsum(n_chunks)))
            upto = np.concatenate(([0], ends))[bounds]
            yield flat[places], np.diff(upto)
            at = to


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process and tokenizer, so that what it has seen serves later tasks."""
    return Encoder(path)
