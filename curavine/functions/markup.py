"""Tags of a page in one pass, in time that grows with its length whatever the markup looks like.

Patterns that look for an end from every beginning take time with the square of the page where ends are missing. Here
every search goes on from where the last one ended, and one that finds no end is not tried again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

_ATTRIBUTE = re.compile(r"([:@\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_URL, _STOP, _QUOTED = re.compile(r"url\((['\"]?)", re.I), re.compile(r"['\")]"), re.compile(r"[\"']([^\"'\s)]+)(?=[\"'])")
_REFERENCES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x2F;", "/"))


class Tag(NamedTuple):
    name: str
    closing: bool
    start: int
    end: int


def tags(page: str, names: tuple[str, ...]) -> Iterator[Tag]:
    """Opening and closing tags of some elements, in order: from "<" and the name to the next ">".

    A tag within another one of its kind is none; within one of another kind, as broken markup has it, it is.
    """
    ends: dict[str, int] = {}
    end = 0
    for m in _opener(names).finditer(page):
        kind = m[1] + m[2].lower()
        if m.start() < ends.get(kind, 0):
            continue
        if end <= m.end():
            end = page.find(">", m.end()) + 1
            if not end:
                return
        ends[kind] = end
        yield Tag(m[2].lower(), bool(m[1]), m.start(), end)


_openers: dict[tuple[str, ...], re.Pattern] = {}


def _opener(names: tuple[str, ...]) -> re.Pattern:
    if names not in _openers:
        _openers[names] = re.compile(rf"<(/?)({'|'.join(names)})\b", re.I)
    return _openers[names]


def elements(page: str, name: str, wanted: Callable[[str], object] = bool) -> Iterator[tuple[Tag, int, int]]:
    """(opening tag, end of its content, end of its closing tag) of elements that don't overlap; unclosed ones are none.

    An element begins at the first tag that is wanted behind the end of the one before.
    """
    open_ = None
    for tag in tags(page, (name,)):
        if not tag.closing:
            open_ = open_ or (tag if wanted(page[tag.start : tag.end]) else None)
        elif open_ is not None and tag.start >= open_.end and page[tag.start : tag.end].lower() == f"</{name}>":
            yield open_, tag.start, tag.end
            open_ = None


def style_urls(page: str) -> Iterator[tuple[int, str]]:
    """(place, address) of url(), quoted or not, wherever it stands."""
    at, stop = 0, None
    while m := _URL.search(page, at):
        if stop is None or stop.start() < m.end():
            stop = _STOP.search(page, m.end())
            if stop is None:
                return
        if stop.start() > m.end() and page.startswith(m[1] + ")", stop.start()):
            yield m.start(), page[m.end() : stop.start()]
            at = stop.end()
        else:
            at = m.start() + 1


def quoted(page: str) -> Iterator[tuple[int, str]]:
    """(place, text) of what stands between two quotes without a quote, white space or closing parenthesis in it."""
    at = 0
    while m := _QUOTED.search(page, at):
        yield m.start(), m[1]
        at = m.end()  # the second quote may be the first of the next


def without_tags(text: str) -> str:
    """The text with a space in place of each tag; "<" without a ">" behind it, and "<>", are text."""
    out, at = [], 0
    while (start := text.find("<", at)) >= 0 and (end := text.find(">", start)) >= 0:
        if end == start + 1:
            out.append(text[at : end + 1])
        else:
            out += [text[at:start], " "]
        at = end + 1
    return "".join([*out, text[at:]])


def without_code(page: str) -> str:
    """The page with a space in place of each script, and then of each style."""
    for name in ("script", "style"):
        out, at = [], 0
        for tag, _, end in elements(page, name):
            out += [page[at : tag.start], " "]
            at = end
        page = "".join([*out, page[at:]]) if out else page
    return page


def plain(page: str) -> str:
    """The text of markup, without scripts and styles, its white space as it is."""
    return without_tags(without_code(page))


def attributes(tag: str) -> dict[str, str]:
    """Attributes of a tag by name in lower case; of repeated ones the last counts."""
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(tag)}


def decoded(text: str) -> str:
    """The few character references that the pages' texts are read with."""
    for name, char in _REFERENCES:
        text = text.replace(name, char)
    return text


def content(page: str, name: str) -> str:
    """What stands in the first element of a name, without tags."""
    for tag, end, _ in elements(page, name):
        return without_tags(page[tag.end : end])
    return ""


def meta(page: str, name: str) -> str:
    """The content of the first meta element of a property or name; one that tells its content first counts after the others."""
    later = ""
    for tag in tags(page, ("meta",)):
        raw = page[tag.start : tag.end]
        own = re.search(rf"(?:property|name)=[\"']{re.escape(name)}[\"']", raw, re.I)
        if own:
            if m := re.search(r"content=[\"']([^\"']+)", raw[own.end() :], re.I):
                return decoded(m[1])
            if not later and (m := re.search(r"content=[\"']([^\"']+)[\"']", raw[: own.start()], re.I)):
                later = m[1]
    return decoded(later)
