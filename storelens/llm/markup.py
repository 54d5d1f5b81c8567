"""Tags of an HTML page, found in one pass whose time is linear in the page's length.

Comments, declarations and CDATA sections are skipped.  A quoted attribute value
ends at its closing quote; a quote that nothing closes is an ordinary character,
so its tag ends at the next ``>``.  A tag that nothing ends takes the rest of the
page, as browsers have it.  ``<`` before anything but a letter or ``/`` and a
letter is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

#: Elements whose content is no markup: it ends at their own closing tag.
RAW = frozenset("script style noscript template textarea iframe svg math object".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*+)|[!?])")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"']++))?|.""", re.DOTALL)
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_HUGE = re.compile(r"&#[1-9][0-9]{7,};?")


class Tag(NamedTuple):
    begin: int
    end: int
    closing: bool
    name: str  # lower case; empty for comments and declarations
    attributes: str


def decoded(text: str) -> str:
    """The text with its character references decoded; numbers beyond Unicode are U+FFFD, however long."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return unescape(text)


class Page:
    """A page and what is known of its ends, so that no search for a missing end is made twice."""

    def __init__(self, text: str):
        self.text = text
        self.last = {mark: text.rfind(mark) for mark in (">", '"', "'", "]]>")}
        self.no_close: dict[str, int] = {}  # from where on an element's closing tag is known to be missing
        self.unbalanced = False  # a tag ran to the end of the page because of its quotes
        #: A caller that has seen where an element ends sets this, and the tags before it are not read.
        self.skip_to = 0

    def _tag_end(self, at: int) -> int:
        """Where a tag whose attributes begin at ``at`` ends, or -1."""
        text = self.text
        if self.last[">"] < at:
            return -1
        if not self.unbalanced:
            now = at
            while True:
                m = _STOP.search(text, now)
                if m is None:
                    self.unbalanced = True
                    break
                if m[0] == ">":
                    return m.start()
                if self.last[m[0]] > m.start():
                    now = text.find(m[0], m.end()) + 1
                else:
                    now = m.end()
        return text.find(">", at)

    def close_of(self, name: str, at: int) -> tuple[int, int] | None:
        """(begin, end) of the element's next closing tag from ``at`` on."""
        if self.last[">"] < at or at >= self.no_close.get(name, len(self.text) + 1):
            return None
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(self.text, at)
        if m is None:
            self.no_close[name] = at
            return None
        return m.span()

    def tags(self) -> Iterator[Tag]:
        """Every tag; what lies between two of them is text.  A raw element's tag takes its whole content with it."""
        text, at = self.text, 0
        while True:
            m = _OPEN.search(text, at)
            if m is None:
                return
            begin, at = m.span()
            if m[2] is None:
                if text.startswith("<!--", begin):
                    if text.startswith(("<!-->", "<!--->"), begin):
                        at = text.find(">", begin) + 1
                    else:
                        end = text.find("-->", begin + 4)
                        at = end + 3 if end >= 0 else len(text)
                elif text.startswith("<![CDATA[", begin) and self.last["]]>"] > begin:
                    at = text.find("]]>", begin) + 3
                else:
                    end = text.find(">", at) if self.last[">"] >= at else -1
                    at = end + 1 if end >= 0 else len(text)
                yield Tag(begin, at, False, "", "")
                continue
            end = self._tag_end(at)
            attributes = text[at:end] if end >= 0 else ""
            at = end + 1 if end >= 0 else len(text)
            name = m[2].lower()
            if name in RAW and not m[1] and end >= 0 and not attributes.endswith("/"):
                found = self.close_of(name, at)
                at = found[1] if found else len(text)
            yield Tag(begin, at, bool(m[1]), name, attributes)
            at = max(at, self.skip_to)


def attributes(text: str) -> dict[str, str]:
    """Names in lower case and decoded values; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        if m[1]:
            value = m[2] or ""
            if value[:1] in "\"'" and value:
                value = value[1:-1]
            out.setdefault(m[1].lower(), decoded(value))
    return out
