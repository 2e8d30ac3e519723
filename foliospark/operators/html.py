"""XHTML chapters to elements: headings, list items, captions, figures and texts in order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import regex
from pyspark.sql import DataFrame

# Tags whose content is no text, those of them without an end, and tags that begin and end a block.
SILENT = ("head", "link", "meta", "script", "style", "title")
ENDLESS = ("link", "meta")
BLOCK_TAGS = ("article", "blockquote", "caption", "dd", "div", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "section", "td", "th", "tr")
KINDS = {"li": "list", "caption": "caption", "figcaption": "caption"}
_SPACE = regex.compile(r"\s+")
_HEADING = regex.compile(r"h([1-6])")
Piece = tuple[str, str, int, str | None]
Event = tuple[str, str, dict]


class _Seen(HTMLParser):
    """What the parser meets, as a flat list: "open", "close" or "text", a name or the text, attributes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.events.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("close", tag, {}))

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data, {}))


def _heard(events: list[Event], endless: tuple[str, ...]) -> Iterator[Event]:
    """The events outside silent tags. One that is never closed silences the rest, if it isn't known to be endless."""
    depth = 0
    for what, name, attrs in events:
        if what != "text" and name in SILENT:
            depth = max(0, depth + {"open": 1, "close": -1}[what] * (name not in endless))
        elif depth == 0:
            yield what, name, attrs


def _runs(events: Iterator[Event]) -> Iterator[tuple[str, str | None, str | None]]:
    """(text, tag, image): text up to each boundary of a block with the tag it belongs to, and images, in order.

    Text before an end tag belongs to that tag, other text to the innermost block that is open.
    """
    around: list[str] = []
    run = ""
    for what, name, attrs in itertools.chain(events, [("close", "", {})]):
        source = attrs.get("src") if name == "img" else None
        boundary = name in BLOCK_TAGS or not name
        if what == "text":
            run += name
        elif what == "open" and name == "br":
            run += " "
        elif boundary or source:
            yield run, (name if what == "close" and name else around[-1] if around else None), None
            run = ""
            if source:
                yield attrs.get("alt") or "", None, source
            elif what == "open":
                around.append(name)
            elif name in around:
                last = max(i for i, x in enumerate(around) if x == name)
                around = around[:last]


def pieces(markup: str | None, void_tags: bool = True) -> list[Piece]:
    """(type, text, level, image_path) of a chapter; markup that can't be parsed gives its bare text as one piece.

    void_tags: whether tags that never end are known as such.
    """
    if not markup:
        return []
    seen = _Seen()
    try:
        seen.feed(markup)
        seen.close()
    except (AssertionError, ValueError, IndexError):  # the parser's own failures
        bare = regex.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<[^>]+>", " ", markup)
        seen.events = [("text", bare, {})]
    out: list[Piece] = []
    for run, tag, image in _runs(_heard(seen.events, ENDLESS if void_tags else ())):
        text = _SPACE.sub(" ", run).strip()
        heading = _HEADING.fullmatch(tag or "")
        if image:
            out.append(("figure", run, 0, image))
        elif text:
            out.append(("heading" if heading else KINDS.get(tag, "text"), text, int(heading[1]) if heading else 0, None))
    return out


def html_elements(pages: DataFrame, void_tags: bool = True) -> DataFrame:
    """Elements of pages (doc_id, page_index, native_html) in Arrow batches, page by page. Null and empty markup gives none."""
    from foliospark.operators.assembly import PAGE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (d, p * PAGE + 1 + i, kind, text, level, src, None, p)
                for d, p, h in zip(b["doc_id"].tolist(), b["page_index"].tolist(), b["native_html"].tolist(), strict=True)
                for i, (kind, text, level, src) in enumerate(pieces(h, void_tags))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "type", "text", "level", "image_path", "html", "page_index"])

    return pages.select("doc_id", "page_index", "native_html").filter("native_html <> ''").mapInPandas(run, "doc_id long, seq long, type string, text string, level int, image_path string, html string, page_index int")
