"""Leaf blocks of a web page: a forgiving tokenizer and the open elements around each run of text."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

# Elements by their role in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style noscript template svg math select datalist button textarea object canvas audio video iframe title".split())
#: What a start tag closes when it is the innermost open element.
CLOSES = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}}
IN_HEAD = frozenset("base link meta noscript script style template title".split())

_NO_BREAK = VOID | RAW
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"""(?:[^>"'=]|=\s*+"[^"]*"|=\s*+'[^']*'|=|["'])*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++))""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_CUT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Block:
    """A run of text between two boundaries of block elements."""

    text: str
    linked: int  # characters inside links
    tag: str  # the innermost block element
    path: frozenset[str]  # tags, classes, ids and roles of all open block elements
    place: int  # number of that innermost element's parent, to tell siblings
    marks: dict[str, str] = field(default_factory=dict)  # attributes of the innermost element


@dataclass
class _Open:
    tag: str
    path: frozenset[str]
    number: int
    marks: dict[str, str]


def _names(tag: str, marks: dict[str, str]) -> set[str]:
    """Features of one element: its tag, and the words of its class, id and role, whole and by their first letters."""
    found = {f"t:{tag}"}
    for name in ("class", "id", "role"):
        for word in _CUT.split(_CAMEL.sub(" ", marks.get(name, "")).lower()):
            if word and not word.isdigit():
                found |= {f"c:{word}", f"p:{word[:5]}"}
    if "hidden" in marks or "display:none" in marks.get("style", "").replace(" ", "").lower():
        found.add("hidden")
    return found


def blocks(page: str) -> list[Block]:
    """All leaf blocks with text, in page order; character references are decoded, white space is one space.

    Elements left open, stray end tags and a page cut off inside a tag are
    taken as browsers do, roughly; nothing makes this fail or go quadratic.
    """
    out: list[Block] = []
    stack = [_Open("", frozenset(), 0, {})]
    counts: dict[str, int] = {}
    run: list[tuple[str, bool]] = []
    links = numbers = unseen = 0

    def finish() -> None:
        text = " ".join("".join(t for t, _ in run).split())
        if text:
            top = stack[-1]
            out.append(Block(text, sum(len(t.strip()) for t, linked in run if linked), top.tag, top.path, stack[-2].number if len(stack) > 1 else 0, top.marks))
        run.clear()

    def close() -> None:
        nonlocal unseen
        tag = stack.pop().tag
        counts[tag] -= 1
        unseen -= tag in UNSEEN

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at and not unseen:
            run.append((entities.unescape(page[at:start]), links > 0))
        if start == size:
            break
        ahead = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        closing = ahead == "/"
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            if closing or ahead in ("!", "?"):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:  # a lone sign
                if not unseen:
                    run.append(("<", links > 0))
                at = start + 1
            continue
        rest = _REST.match(page, name.end())
        if not rest:
            break  # the page ends inside a tag
        at, tag = rest.end(), name[0].lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag in ("br", "wbr") and not unseen:
                run.append((" " if tag == "br" else "", links > 0))
            continue
        finish()
        if closing:
            if counts.get(tag):
                while stack[-1].tag != tag:
                    close()
                close()
                links = 0
            continue
        while len(stack) > 1 and (stack[-1].tag in CLOSES.get(tag, ()) or (stack[-1].tag == "p" and tag not in _NO_BREAK) or (stack[-1].tag == "head" and tag not in IN_HEAD)):
            close()
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            close_at = size if not end else page.find(">", end.end())
            at = size if close_at < 0 or not end else close_at + 1
            continue
        if tag in VOID:
            continue
        marks = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(page, name.end(), at)} if at - name.end() > 2 else {}
        if at - name.end() > 2 and " hidden" in page[name.end() : at]:
            marks.setdefault("hidden", "")
        own, path = _names(tag, marks), stack[-1].path
        numbers += 1
        stack.append(_Open(tag, path if own <= path else path | own, numbers, marks))
        counts[tag] = counts.get(tag, 0) + 1
        unseen += tag in UNSEEN
    finish()
    return out
