"""Leaf blocks of an HTML page: their text, tag path and features."""

from __future__ import annotations

import html
import math
import re
from zlib import crc32

import numpy as np

PATH_SLOTS, WORD_SLOTS, NUMBERS = 4096, 2048, 8
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
NAME = re.compile("[a-z]+|[0-9]+")
BLOCK = frozenset("address article aside audio blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript object ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# The text of these is no part of the page; without an end tag they reach to its end, as the parsing rules say.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
# Pages often leave these open by mistake: one without an end tag before the next of its kind is passed over.
OPEN = frozenset("audio button canvas noscript object option select template video".split())
CLOSES_P = BLOCK - OPEN - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "legend", "optgroup"}


def path_tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for _, value in ATTRIBUTE.findall(attributes):
        out += ["." + w for w in NAME.findall(value.lower())]
    return tuple(out)


def closed(tag: str, page: str, at: int) -> bool:
    """Whether the element opened before at ends before the next of its kind opens."""
    found = re.compile(f"<(/?){tag}\\b", re.I).search(page, at)
    return found is not None and found[1] == "/"


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path tokens, text, code points in links) of each leaf block in page order; character references are decoded."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links, at, n = 0, 0, 0, len(page)

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((tuple(t for _, own in stack for t in own), text, linked))
        parts, linked = [], 0

    def leave(tag, until=()):
        nonlocal links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                if any(t in BLOCK for t, _ in stack[k:]):
                    flush()
                links -= sum(t == "a" for t, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    while at < n:
        found = TOKEN.search(page, at)
        start = found.start() if found else n
        if start > at:
            text = html.unescape(page[at:start])
            parts.append(text)
            if links > 0:
                linked += len(text)
        if not found:
            break
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            leave(tag, ("table",) if tag not in BLOCK else ())
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in OPEN and not closed(tag, page, at):
            if tag == "option":
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in CLOSES_P:
            leave("p", ("td", "th", "table", "button"))
        elif tag == "li":
            leave("li", ("ul", "ol", "menu"))
        elif tag in ("td", "th", "tr"):
            leave("td", ("table",))
            leave("th", ("table",))
            if tag == "tr":
                leave("tr", ("table",))
        elif tag in ("dd", "dt"):
            leave("dd", ("dl",))
            leave("dt", ("dl",))
        if tag in BLOCK:
            flush()
        if tag not in VOID:
            stack.append((tag, path_tokens(tag, attributes)))
            links += tag == "a"
    flush()
    return out


class Features:
    """Feature vectors of blocks: hashed tag-path and word slots, and numbers."""

    def __init__(self):
        self.slots: dict[str, int] = {}

    def slot(self, token: str, salt: int, size: int) -> int:
        found = self.slots.get(token)
        if found is None:
            if len(self.slots) > 200_000:
                self.slots.clear()
            found = self.slots[token] = crc32(token.encode(), salt) % size
        return found

    def path(self, tokens: tuple[str, ...]) -> list[int]:
        tail = "/" + "/".join([t for t in tokens if t[0] != "."][-3:])
        return [self.slot(t, 1, PATH_SLOTS) for t in {*tokens, tail}]

    def words(self, text: str) -> list[int]:
        return [self.slot("w " + w, 2, WORD_SLOTS) for w in NAME.findall(text.lower())]

    @staticmethod
    def numbers(block, place: float, repeats: int) -> list[float]:
        path, text, linked = block
        n = len(text)
        return [math.log1p(n) / 5 - 0.8, min(1.0, linked / n), place - 0.5, sum(map(text.count, ".,;!?")) * 10 / (n + 10), float(text[-1] in ".!?:\"'"), len(path) / 10 - 0.5, float("a" in path), float(repeats > 1)]


def feature_arrays(pages: list[list]) -> tuple:
    """For pages of blocks: flat path slots with owners, flat word slots with owners, numbers; blocks numbered through."""
    make, path, path_of, word, word_of, numbers, at = Features(), [], [], [], [], [], 0
    for page in pages:
        seen: dict = {}
        for b in page:
            seen[b[1]] = seen.get(b[1], 0) + 1
        for k, b in enumerate(page):
            p, w = make.path(b[0]), make.words(b[1])
            path += p
            path_of += [at] * len(p)
            word += w
            word_of += [at] * len(w)
            numbers.append(make.numbers(b, k / max(1, len(page) - 1), seen[b[1]]))
            at += 1
    as_int = lambda x: np.array(x, dtype=np.int64)
    return as_int(path), as_int(path_of), as_int(word), as_int(word_of), np.array(numbers, dtype=np.float32).reshape(at, NUMBERS)
