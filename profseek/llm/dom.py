"""Leaf blocks of HTML: stretches of text between the borders of block elements, with the elements around them.

A small tolerant reader: unclosed paragraphs, items and cells end where HTML
ends them, an end tag closes what is open inside its element, unknown and inline
tags only separate what their own text separates. Text of scripts, styles,
templates, form controls and embedded objects is no text. Character references
are decoded within each run of text, white space becomes one space.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

# Element names of HTML by their role.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section
summary table tbody td tfoot th thead tr ul""".split())
UNREAD = frozenset("""audio button canvas datalist head iframe math noembed noframes noscript object script select style
svg template textarea title video xmp""".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements that a start tag ends, and those beyond which it does not look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
CELLS = frozenset("caption dd dt li tbody td tfoot th thead tr html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<[!?/][^>]*+>", re.S)
_NAMES = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?",
                    re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """An element by tag, the parts of its class, id and role in small letters, and the element around it."""

    __slots__ = ("tag", "names", "parent")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None) -> None:
        self.tag, self.names, self.parent = tag, names, parent


class Block(NamedTuple):
    text: str
    linked: int  # characters of the text that are in links
    element: Element


def _names(attributes: str) -> tuple[str, ...]:
    found = set()
    for key, a, b, c in _NAMES.findall(attributes):
        key = key.lower()
        if key in ("hidden", "aria-hidden"):
            if "false" not in (a, b, c):
                found.add("hidden")
        else:
            found.update(p.lower() for p in _PART.findall(a or b or c))
    return tuple(sorted(found))


def _closed(stack: list[Element], tags: set[str], beyond: set[str]) -> None:
    """Close the innermost open element of `tags`, unless one of `beyond` is around it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in beyond:
            return


def leaf_blocks(page: str) -> Iterator[Block]:
    """The blocks of a page in order, those without text left out."""
    stack = [Element("body", (), None)]
    parts: list[str] = []
    linked: list[str] = []
    in_link, unread, at, end = False, 0, 0, len(page)

    def flushed() -> Iterator[Block]:
        text = " ".join("".join(parts).split())
        if text:
            yield Block(text, len(" ".join("".join(linked).split())), stack[-1])
        parts.clear()
        linked.clear()

    def add(piece: str) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        parts.append(piece)
        if in_link:
            linked.append(piece)

    while at < end:
        open_ = page.find("<", at)
        if open_ < 0:
            open_ = end
        if open_ > at:
            if not unread:
                add(page[at:open_])
            at = open_
            continue
        m = _TAG.match(page, at)
        if not m:  # a lone sign, or a tag cut off at the end of the page
            if re.match(r"</?[a-zA-Z!?]", page[at:at + 3]):
                break
            if not unread:
                add("<")
            at += 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in UNREAD:
            if tag in RAW:
                if not closing and not (m[3] or "").endswith("/"):
                    over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = over.end() if over else end
            elif closing:
                unread = max(0, unread - 1)
            elif not (m[3] or "").endswith("/"):
                unread += 1
            continue
        if tag == "body":
            unread = 0  # a head that was not closed ends here
            if not closing and m[3]:
                stack[0] = Element("body", _names(m[3]), None)
            yield from flushed()
            continue
        if unread or tag == "html":
            continue
        if tag == "br":
            parts.append(" ")
            linked.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCKS:
            yield from flushed()
            if closing:
                if any(e.tag == tag for e in stack[1:]):
                    _closed(stack, {tag}, set())
                in_link = False
                continue
            if tag not in CELLS:
                _closed(stack, {"p"}, {"td", "th", "table", "div", "section", "article", "li", "dd", "blockquote"})
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
            if tag in ENDS:
                _closed(stack, *ENDS[tag])
            if tag != "hr":
                stack.append(Element(tag, _names(m[3]) if m[3] else (), stack[-1]))
    yield from flushed()
