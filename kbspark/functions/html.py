"""Text, title and links of HTML pages, in one parser pass a page."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Elements whose text is never shown, those that never hold content, and those allowed in a head (fixed values).
HIDDEN = frozenset({"script", "style", "template", "noscript", "head", "title"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())


class _Page(HTMLParser):
    """Collects the shown text nodes, the first title and heading, and the link targets in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.parts: list[str] = []
        self.links: list[str] = []
        self.named: dict[str, list[list[str]]] = {"title": [], "h1": []}
        self.inside: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (target := next((v for k, v in attrs if k == "href"), None)) is not None:
            self.links.append(target)
        if tag in VOID:
            return
        if "head" in self.open and (tag == "body" or tag not in HEAD_ONLY and self.open[-1] == "head"):
            self._leave(self.open.index("head"))  # a head left open ends where content begins
        self.open.append(tag)
        self.hidden += tag in HIDDEN
        if tag in self.named:
            self.named[tag].append([])

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at] == tag:
                self._leave(at)
                return

    def _leave(self, at: int) -> None:
        self.hidden -= sum(t in HIDDEN for t in self.open[at:])
        del self.open[at:]

    def handle_data(self, data):
        for tag, found in self.named.items():
            if found and tag in self.open:
                found[-1].append(data)
        if not self.hidden and data.strip():
            self.parts.append(" ".join(data.split()))

    def title(self) -> str:
        """The first title, else the first heading with text."""
        first = "".join(self.named["title"][0]).strip() if self.named["title"] else ""
        return first or next((t for h in self.named["h1"] if (t := "".join(h).strip())), "")


PARSED = T.StructType().add("text", T.StringType()).add("title", T.StringType()).add("links", T.ArrayType(T.StringType()))


@F.pandas_udf(PARSED)
def parsed(html: pd.Series) -> pd.DataFrame:
    """What a page holds; all fields of a null page are null."""
    rows = []
    for source in html:
        if source is None:
            rows.append((None, None, None))
            continue
        page = _Page()
        page.feed(source)
        page.close()
        rows.append(("\n".join(page.parts), page.title(), page.links))
    return pd.DataFrame(rows, columns=["text", "title", "links"])


def visible_text(html: Column | str) -> Column:
    """Text nodes of a page, one per line."""
    return parsed(html)["text"]


def page_title(html: Column | str) -> Column:
    """The title, else the first heading with text, else an empty string."""
    return parsed(html)["title"]


def hrefs(html: Column | str) -> Column:
    """Targets of the links in document order."""
    return parsed(html)["links"]
