"""Leaf blocks of an HTML page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# HTML's element kinds, as far as they matter for blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template svg iframe object canvas math".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
SCOPES = frozenset("table ul ol dl select article section aside nav form div body".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    """`tags`: open elements, `inner` the innermost; `names`: words of their classes, ids and roles; `linked`: characters inside links."""

    text: str
    tags: frozenset[str]
    inner: str
    names: frozenset[str]
    linked: int
    marked: bool


def _names(attributes: str) -> tuple[frozenset[str], bool]:
    found: set[str] = set()
    if "=" in attributes:
        for _, *values in _NAMED.findall(attributes):
            found.update(w.lower() for w in _HUMPS.findall("".join(values)))
    return frozenset(found), "data-main" in attributes


def blocks(page: str) -> list[Block]:
    """The blocks that have text, in page order, with references decoded and white space turned into single blanks."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool]] = []
    tags: Counter[str] = Counter()  # of the open elements, so that a block under many costs no more than one under few
    names: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = marks = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, frozenset(tags), stack[-1][0] if stack else "", frozenset(names), min(linked, len(text)), bool(marks)))
        parts.clear()
        linked = 0

    def count(element: tuple[str, frozenset[str], bool], by: int) -> None:
        nonlocal links, marks
        for counts, keys in ((tags, element[:1]), (names, element[1])):
            for key in keys:
                counts[key] += by
                if not counts[key]:
                    del counts[key]
        links += by * (element[0] == "a")
        marks += by * element[2]

    def close(tag: str) -> None:
        if tag in tags:
            element = None
            while element is None or element[0] != tag:
                element = stack.pop()
                count(element, -1)

    while True:
        found = _MARKUP.search(page, at)
        text = page[at:found.start() if found else len(page)]
        if text:
            parts.append(text)
            linked += len(text) if links else 0
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        ends, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in HIDDEN_TAGS:
            if not ends and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br" or tag in VOID_TAGS:
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if ends:
            close(tag)
            continue
        if block and ("p" in tags or not tags.keys().isdisjoint(CLOSES.get(tag, ()))):
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item its sibling
                if stack[k][0] == "p" or stack[k][0] in CLOSES.get(tag, ()):
                    close(stack[k][0])
                    break
                if stack[k][0] in SCOPES:
                    break
        stack.append((tag, *_names(attributes)))
        count(stack[-1], 1)
    flush()
    return out
