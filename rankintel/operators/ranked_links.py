"""Ranked web results of saved search pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Tape(HTMLParser):
    """Flat record of the anchor, heading and text events of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "h3"):
            self.events.append((tag, dict(attrs).get("href") or ""))

    def handle_endtag(self, tag):
        if tag in ("a", "h3"):
            self.events.append(("/" + tag, ""))

    def handle_data(self, data):
        self.events.append(("text", data))


def heading_links(html: str) -> list[dict[str, str]]:
    """(url, title) of each level-3 heading inside an absolute link, first title per url, page order."""
    tape = _Tape()
    tape.feed(html)
    targets: list[str] = []
    titles: dict[str, str] = {}
    heading: list[str] | None = None
    link = ""
    for event, value in tape.events:
        match event:
            case "a":
                targets.append(value if value.startswith("http") else "")
            case "/a":
                del targets[-1:]
            case "h3":
                heading = []
                link = next(filter(None, reversed(targets)), "")
            case "text" if heading is not None:
                heading.append(value)
            case "/h3" if heading is not None:
                title = "".join(heading).strip()
                heading = None
                if link and title:
                    titles.setdefault(link, title)
    return [{"url": url, "title": title} for url, title in titles.items()]


LINKS_TYPE = T.ArrayType(T.StructType().add("url", T.StringType()).add("title", T.StringType()))


@F.pandas_udf(LINKS_TYPE)
def _heading_links(html: pd.Series) -> pd.Series:
    return html.map(heading_links)


def ranked_links(pages: DataFrame, top: int = 10, query: str = "query", html: str = "html") -> DataFrame:
    """query, position, url, title, snippet (plus any other page columns) of the first `top` links per page.

    A page is one row, so ranking and deduplication stay inside the row and nothing is shuffled.
    """
    kept = [c for c in pages.columns if c not in (query, html, "url", "title")]
    found = pages.where(F.length(html) > 0).select(F.col(query).alias("query"), *kept, _heading_links(html).alias("_links"))
    return found.select(
        "query", *kept, F.posexplode(F.slice("_links", 1, top)).alias("_pos", "_link")
    ).select(
        "query",
        (F.col("_pos") + 1).alias("position"),
        "_link.url",
        "_link.title",
        F.lit("").alias("snippet"),
        *kept,
    )
