"""A scanner for HTML: tags, attributes and raw text, as a state machine over a page.

It follows the public HTML tokenization rules as far as links need them: attribute values in
either quotes or none, ``>`` inside quotes, unterminated quotes and tags (which give no tag),
comments in all their forms, declarations and processing instructions, and elements whose
content is text up to their own end tag (script, style, textarea, title, iframe and others,
scripts with their escaped parts). Character references in values are decoded by the
standard library's table, with the rule that keeps ``&copy=1`` in an address as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

# Elements whose content is not markup, the second group with references decoded.
RAW_TEXT = ("script", "style", "xmp", "iframe", "noembed", "noframes")
TEXT_ONLY = ("textarea", "title")
PLAIN = "plaintext"

_SPACE = " \t\n\f\r"
_TAG_NAME_END = re.compile(r"[ \t\n\f\r/>]")
_NAME_END = re.compile(r"[ \t\n\f\r/>=]")
_VALUE_END = re.compile(r"[ \t\n\f\r>]")
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[0-9a-zA-Z]+;?)")


def decoded(value: str) -> str:
    """An attribute value with its character references replaced.

    A name without semicolon that goes on with ``=`` or a letter or digit stays as it is.
    """
    if "&" not in value:
        return value

    def one(match: re.Match) -> str:
        text = match.group()
        if text[1] == "#" or text.endswith(";") and text[1:] in html5:
            return unescape(text)
        # the longest known name at the start; one without semicolon must be the whole word
        follows = value[match.end() : match.end() + 1]
        if text[1:] in html5 and follows != "=":
            return unescape(text)
        return text

    return _REFERENCE.sub(one, value)


def _skip_space(page: str, at: int) -> int:
    n = len(page)
    while at < n and page[at] in _SPACE:
        at += 1
    return at


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int, bool]:
    """Attributes from a place after a tag's name, the place after its ``>``, and whether it ended in ``/``.

    The place is -1 if the page ends first, as then there is no tag.
    """
    out, n, closed = [], len(page), False
    while True:
        at = _skip_space(page, at)
        if at >= n:
            return out, -1, False
        if page[at] == ">":
            return out, at + 1, closed
        if page[at] == "/":
            closed, at = True, at + 1
            continue
        closed = False
        # an equals sign at the start is part of the name
        end = _NAME_END.search(page, at + 1)
        if end is None:
            return out, -1, False
        name, at = page[at : end.start()].lower(), _skip_space(page, end.start())
        if at >= n:
            return out, -1, False
        value = ""
        if page[at] == "=":
            at = _skip_space(page, at + 1)
            if at >= n:
                return out, -1, False
            if page[at] in "\"'":
                stop = page.find(page[at], at + 1)
                if stop < 0:
                    return out, -1, False
                value, at = page[at + 1 : stop], stop + 1
            elif page[at] != ">":
                stop = _VALUE_END.search(page, at)
                if stop is None:
                    return out, -1, False
                value, at = page[at : stop.start()], stop.start()
        out.append((name, value))


def _comment_end(page: str, at: int) -> int:
    """Place after a comment whose text starts at ``at``; the page's end if it is open."""
    if page.startswith(">", at):
        return at + 1
    if page.startswith("->", at):
        return at + 2
    end = _COMMENT_END.search(page, at)
    return len(page) if end is None else end.end()


def _raw_end(page: str, name: str, at: int) -> int:
    """Place of the end tag of an element whose content is text; the page's end if there is none."""
    if name == "script":
        return _script_end(page, at)
    end = _END_TAG[name].search(page, at)
    return len(page) if end is None else end.start()


def _script_end(page: str, at: int) -> int:
    """Like ``_raw_end``, where ``<!--`` hides a nested script with its end tag up to ``-->``."""
    escaped, nested = False, False
    while mark := _SCRIPT_MARK.search(page, at):
        text, at = mark.group().lower(), mark.end()
        if text == "<!--":
            # its dashes may close it at once
            escaped, at = True, mark.start() + 2
        elif text == "-->":
            escaped = nested = False
        elif text == "<script":
            nested = escaped
        elif not nested:
            return mark.start()
        else:
            nested = False
    return len(page)


_END_TAG = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.IGNORECASE) for name in (*RAW_TEXT, *TEXT_ONLY)}
_SCRIPT_MARK = re.compile(r"<!--|-->|</?script(?=[ \t\n\f\r/>])", re.IGNORECASE)


def start_tags(page: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Start tags with their attributes as written, names in lower case, in order of the page."""
    at, n = 0, len(page)
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= n:
            return
        mark = page[at + 1]
        if mark.isascii() and mark.isalpha():
            end = _TAG_NAME_END.search(page, at + 1)
            if end is None:
                return
            name = page[at + 1 : end.start()].lower()
            attributes, after, _ = _attributes(page, end.start())
            if after < 0:
                return
            yield name, attributes
            at = after
            if name == PLAIN:
                return
            if name in _END_TAG:
                at = _raw_end(page, name, at)
        elif mark == "!":
            if page.startswith("--", at + 2):
                at = _comment_end(page, at + 4)
            else:
                # declarations, and CDATA outside of foreign elements, end at the next ``>``
                at = page.find(">", at)
                at = n if at < 0 else at + 1
        elif mark == "/" and at + 2 < n and page[at + 2].isascii() and page[at + 2].isalpha():
            end = _TAG_NAME_END.search(page, at + 2)
            after = -1 if end is None else _attributes(page, end.start())[1]
            if after < 0:
                return
            at = after
        elif mark in "/?":
            # no tag: passed over as a comment, ``</>`` as nothing
            at = page.find(">", at)
            at = n if at < 0 else at + 1
        else:
            at += 1


def page_links(page: str | None, tags: tuple[str, ...] = ("a", "area")) -> tuple[str | None, list[str]]:
    """The first base address of a page, None if it has none, and its link texts.

    Link texts come in order and once each, decoded and without blanks around them. Of an
    attribute that occurs twice in a tag the first counts.
    """
    base, links = None, {}
    for name, attributes in start_tags(page or ""):
        if name in tags or name == "base" and base is None:
            href = next((value for key, value in attributes if key == "href"), None)
            if href is None:
                continue
            href = decoded(href).strip(_SPACE)
            if name == "base":
                base = href
            else:
                links.setdefault(href)
    return base, list(links)
