"""Main text, title and quality of HTML pages; the block rules run in Python by batches, the simple ones in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text, and elements that make blocks (fixed values).
DROPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe"}
BLOCKS = {"p", "div", "article", "section", "td", "li", "blockquote", "h1", "h2", "h3"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.links, self.deep, self.anchor = [], [], 0, 0, 0

    def close_block(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((text, self.links))
        self.text, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.deep += 1
        elif tag in BLOCKS:
            self.close_block()
        elif tag == "a":
            self.anchor += 1
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.deep = max(0, self.deep - 1)
        elif tag in BLOCKS:
            self.close_block()
        elif tag == "a":
            self.anchor = max(0, self.anchor - 1)

    def handle_data(self, data):
        if not self.deep:
            self.text.append(data)
            if self.anchor:
                self.links += len(data.strip())


def blocks(html: str, words: int = 20, links: float = 0.5) -> str:
    """The blocks with enough words and few links, a blank line between them."""
    p = _Blocks()
    p.feed(html)
    p.close_block()
    return "\n\n".join(t for t, n in p.blocks if len(t.split()) >= words and n <= links * len(t))


def extract(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text) of pages; null pages give null, empty ones an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b["k"], "text": [blocks(x) if isinstance(x, str) else None for x in b["h"]]})

    return df.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def title(html: Column) -> Column:
    found = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("Untitled"))


def quality(words: Column) -> Column:
    """Whether an array of words passes: 20 words or more, mean length 2 to 15, no word above 30 per cent."""
    n = F.size(words)
    mean = F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s + F.length(x)) / n
    most = F.array_max(F.transform(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w))))
    return F.coalesce((n >= 20) & mean.between(2, 15) & (most <= 0.3 * n), F.lit(False))
