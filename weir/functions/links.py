"""Links out of HTML: a strict extractor for well-formed pages, and a lenient one for any."""

from __future__ import annotations

import io
import xml.sax
from collections.abc import Iterator
from xml.sax.handler import ContentHandler, feature_external_ges, feature_external_pes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .text import target

#: The id of the element that holds a page's text.
CONTENT = "bodyContent"


class _Links(ContentHandler):
    """Collects what anchors inside content elements point to. The region ends with the element that opened it; a
    later one opens it again, one inside only nests."""

    def __init__(self):
        super().__init__()
        self.depth, self.found = 0, []

    def startElement(self, name, attrs):
        if self.depth:
            self.depth += 1
            if name.lower() == "a" and attrs.get("href") is not None:
                self.found.append(attrs["href"])
        elif name.lower() == "div" and attrs.get("id", "").lower() == CONTENT.lower():
            self.depth = 1

    def endElement(self, name):
        if self.depth:
            self.depth -= 1


def hrefs(html: str | None) -> list[str] | None:
    """A page's links in order, with repeats; None where it is not well-formed XML, which discards the page whole."""
    parser, handler = xml.sax.make_parser(), _Links()
    parser.setContentHandler(handler)
    parser.setFeature(feature_external_ges, False)
    parser.setFeature(feature_external_pes, False)
    try:
        parser.parse(io.BytesIO((html or "").encode()))
    except (xml.sax.SAXException, ValueError):
        return None
    return handler.found


def strict_links(pages: DataFrame) -> DataFrame:
    """pages: page, html. Returns page and links: the pages named by relative links in the page's content, decoded;
    pages that don't parse are left out with all their links."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hrefs(x) for x in batch.column(1).to_pylist()]
            ok = pa.array([x is not None for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["page", "hrefs"]).filter(ok)

    raw = pages.select("page", "html").mapInArrow(run, "page string, hrefs array<string>")
    return raw.select("page", F.filter(F.transform("hrefs", target), lambda x: x.isNotNull()).alias("links"))


def lenient_hrefs(html: Column) -> Column:
    """Every double-quoted href, well-formed page or not."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)
