"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

Every block of a page is main text or not. A block's features are its ancestors' tags, the words of their classes, ids and roles, and
measures of its text; two by two transition weights tie neighbours. Weights are fitted to labelled pages by gradient steps on
the likelihood (forward-backward), and a page is decoded by Viterbi. The labelled pages are a few hundred, a bound that
is a parameter, so the model is some hundred numbers and goes to the tasks with the function.

Rules: a null or empty page has no text; a page without main blocks has none either. Broken markup is read as far as it
can be; text outside of any element is a block like others. Equal rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrail.llm.dom import Block, blocks
from daytrail.llm.page_layouts import labelled_pages

#: Words that sites name their parts by, under the part they name.
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs crumbs topnav", "head": "header masthead top brand",
    "foot": "footer bottom colophon copyright legal", "side": "sidebar side widget rail aside",
    "ad": "ad ads advert advertisement advertising sponsored sponsor promo banner adsense", "note": "cookie cookies notice consent gdpr popup alert modal",
    "talk": "comment comments reply replies response responses discussion disqus", "form": "newsletter subscribe signup login search form",
    "more": "related recommended trending popular share social follow", "main": "content article post entry story body text main",
}
PART_OF = {word: part for part, words in PARTS.items() for word in words.split()}


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(page):
        words = b.text.split()
        own = [f"t:{t}" for t in b.tags] + [f"in:{b.inner}"]
        own += [f"n:{part}" for part in {PART_OF[w] for w in b.names if w in PART_OF}]
        own.append(f"words:{min(len(words).bit_length(), 6)}")
        own.append(f"links:{4 * b.linked // max(len(b.text), 1)}")
        own.append(f"end:{b.text[-1] in '.!?:'}")
        own.append(f"copy:{'©' in b.text}")
        own.append(f"stops:{min(sum(c in '.,;!?' for c in b.text) * 20 // len(b.text), 3)}")
        own.append(f"first:{i == 0}")
        out.append(own)
    return out


@dataclass
class Field:
    """Weights of a block being main text by feature, and of (label, next label)."""

    weights: dict[str, float]
    steps: np.ndarray

    def decode(self, page: list[list[str]]) -> list[bool]:
        (a, b), (c, d) = self.steps.tolist()
        get, zero, one, back = self.weights.get, 0.0, 0.0, []
        for own in page:
            emit = sum(get(f, 0.0) for f in own)
            if back:
                to0, to1 = one + c > zero + a, one + d > zero + b
                back.append((to0, to1))
                zero, one = (one + c if to0 else zero + a), (one + d if to1 else zero + b) + emit
            else:
                back.append((False, False))
                one = emit
        labels, label = [], one > zero
        for to0, to1 in reversed(back):
            labels.append(label)
            label = to1 if label else to0
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = 120, rate: float = 0.15, decay: float = 0.02) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over all pages at once."""
    names = sorted({f for page, _ in pages for own in page for f in own})
    number = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(p) for p, _ in pages)
    owner = np.array([i * longest + t for i, (page, _) in enumerate(pages) for t, own in enumerate(page) for _ in own])
    used = np.array([number[f] for page, _ in pages for own in page for f in own])
    alive, gold = np.zeros((n, longest)), np.zeros((n, longest), int)
    for i, (page, labels) in enumerate(pages):
        alive[i, :len(page)], gold[i, :len(page)] = 1, labels
    pairs = alive[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), pairs.ravel())
    theta = np.zeros(len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = np.bincount(owner, w[used], n * longest).reshape(n, longest)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + trans, axis=1) + emit[:, t]
            forward[:, t] = np.where(alive[:, t, None] > 0, new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(trans + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(alive[:, t + 1, None] > 0, new, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        main = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * alive
        both = np.exp(forward[:, :-1, :, None] + trans + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        slope = np.concatenate((np.bincount(used, ((gold - main) * alive).ravel()[owner], len(names)),
                                (seen - (both * pairs[:, :, None, None]).sum((0, 1))).ravel())) - decay * theta * n / 100
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, theta[:-4].tolist(), strict=True)), theta[-4:].reshape(2, 2))


def trained(most: int = 400) -> Field:
    """The field of `most` labelled pages."""
    pages = [blocks(p) for p in labelled_pages(most)]
    return fit([(features(p), [b.marked for b in p]) for p in pages if p])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, main in zip(found, field.decode(features(found)), strict=True) if main)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row a page."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [main_text(p.as_py(), field) for p in part["html"]]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id LONG, url STRING, text STRING, n_chars LONG")
