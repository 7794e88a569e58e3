"""Pages as rows of markup events.

Spark has no tolerant HTML parser (``xpath`` raises on ordinary HTML), so one ``mapInPandas`` job turns
each page into an array of events, and nothing else happens in Python. An element is ``(open, close, tag,
attrs)``, where open and close are event numbers of the page; a piece of text is ``(open, close = open,
text)``. What lies inside an element lies between its numbers. Every event also has its place ``at`` in the
page's array (from 1) and ``size``, the number of events inside it, which follow it there: an element's inside is
one slice. Selection, dropping, nesting and text are column expressions over the array
(:mod:`newsdigest.sources.extract`).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd

#: the attribute that holds an element's place in the XML form of a page
PLACE = "_at"
_NO_NAME = re.compile(r"[^A-Za-z0-9_.-]")
_NO_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}
_ESCAPED = re.compile("[&<>\"\t\n\r]")

EVENTS = "array<struct<open: int, close: int, tag: string, attrs: map<string, string>, text: string, at: int, size: int>>"

#: Elements without an end tag, and start tags that end an open paragraph.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_P = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "article", "section", "nav", "footer", "header",
            "table", "blockquote", "pre", "form"}
LISTS = {"ul", "ol"}


class _Events(HTMLParser):
    """Numbers the events of one page; ``depth`` holds the elements that are open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.number, self.events, self.depth = 0, [], []

    def _next(self) -> int:
        self.number += 1
        return self.number

    def _end_from(self, level: int) -> None:
        while len(self.depth) > level:
            self._close(self.depth.pop())

    def _close(self, event: dict) -> None:
        event["close"], event["size"] = self._next(), len(self.events) - event["at"]

    def _innermost(self, tags) -> int:
        return max((i for i, e in enumerate(self.depth) if e["tag"] in tags), default=-1)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and (at := self._innermost({"p"})) >= 0:
            self._end_from(at)
        if tag == "li" and (at := self._innermost({"li"})) > self._innermost(LISTS):
            self._end_from(at)
        event = self._element(tag, attrs)
        if tag in VOID:
            self._close(event)
        else:
            self.depth.append(event)

    def handle_startendtag(self, tag, attrs):
        self._close(self._element(tag, attrs))

    def _element(self, tag, attrs) -> dict:
        event = {"open": self._next(), "close": 0, "tag": tag, "attrs": {k: v or "" for k, v in attrs}, "text": None,
                 "at": len(self.events) + 1, "size": 0}
        self.events.append(event)
        return event

    def handle_endtag(self, tag):
        if (at := self._innermost({tag})) >= 0:
            self._end_from(at)

    def handle_data(self, data):
        at = self._next()
        self.events.append({"open": at, "close": at, "tag": None, "attrs": None, "text": data, "at": len(self.events) + 1, "size": 0})


def events(html: str | None) -> list[dict]:
    p = _Events()
    p.feed(html or "")
    p.close()
    p._end_from(0)
    return p.events


#: A batch that leaves Python ends with so many pages, or with the page that brings its events to so many.
BATCH_ROWS, BATCH_EVENTS = 64, 20000


def map_events(batches):
    """Batches with an ``html`` column to the same columns and ``events`` in its place. Events take far more memory than
    the markup, so a batch of pages leaves in small ones."""
    def out(pdf, at, pages):
        own = pdf.iloc[at:at + len(pages)]
        return pd.concat([own.drop(columns="html"), pd.Series(pages, index=own.index, name="events", dtype=object)], axis=1)

    for pdf in batches:
        at, pages, size = 0, [], 0
        for h in pdf["html"]:
            pages.append(events(h))
            size += len(pages[-1])
            if len(pages) == BATCH_ROWS or size >= BATCH_EVENTS:
                yield out(pdf, at, pages)
                at, pages, size = at + len(pages), [], 0
        if pages:
            yield out(pdf, at, pages)


# --- pages as XML ---------------------------------------------------------------------

def _name(name: str) -> str:
    name = _NO_NAME.sub("_", name)
    return name if name[:1].isalpha() and not name.startswith("xmlns") else f"_{name}"


def _escaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: _ESCAPES[m[0]], _NO_XML.sub("\ufffd", text))


def xml(page: list[dict]) -> tuple[bytes, list[int], list[int]]:
    """A page's events as well-formed XML in UTF-8, and for each event the byte where its element begins there (from 1) and
    its length in bytes (texts: 0 and 0), which cut it out in time that grows with the element alone. Every element has its place in the attribute ``_at``. The root is the page's first outermost
    ``html``, which then holds the whole page; a page without one gets an ``html`` and a ``body`` around it. Letters
    that XML does not allow are ``_`` in names and U+FFFD elsewhere."""
    out, length, begins, sizes = [], 0, [0] * len(page), [0] * len(page)

    def put(piece: str) -> None:
        nonlocal length
        out.append(piece.encode())
        length += len(out[-1])

    def start(e: dict) -> str:
        own = {}
        for k, v in e["attrs"].items():
            own.setdefault(_name(k), v)
        own.pop(PLACE, None)
        return f'<{_name(e["tag"])} {PLACE}="{e["at"]}"' + "".join(f' {k}="{_escaped(v)}"' for k, v in own.items()) + ">"

    def close(e: dict) -> None:
        put(f'</{_name(e["tag"])}>')
        sizes[e["at"] - 1] = length + 1 - begins[e["at"] - 1]

    outermost, after = [], 0
    for e in page:
        if e["at"] > after:
            outermost.append(e)
            after = e["at"] + e["size"]
    root = next((e for e in outermost if e["tag"] == "html"), None)
    if root is None:
        put("<html><body>")
    else:
        begins[root["at"] - 1] = 1
        put(start(root))
    opened = []
    for e in page:
        while opened and e["at"] > opened[-1]["at"] + opened[-1]["size"]:
            close(opened.pop())
        if e["tag"] is None:
            put(_escaped(e["text"]))
        elif e is not root:
            begins[e["at"] - 1] = length + 1
            put(start(e))
            opened.append(e)
    while opened:
        close(opened.pop())
    if root is None:
        put("</body></html>")
    else:
        close(root)
    return b"".join(out), begins, sizes


def map_xml(batches):
    """Like :func:`map_events`, with the page's XML form and its places there as well."""
    for pdf in map_events(batches):
        forms = [xml(page) for page in pdf["events"]]
        yield pdf.assign(**{name: pd.Series([f[i] for f in forms], index=pdf.index, dtype=object) for i, name in enumerate(("xml", "begins", "sizes"))})
