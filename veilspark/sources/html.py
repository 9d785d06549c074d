"""Text of HTML: a chain of built-in functions for everyday pages, and a parser in an Arrow pass for any page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.frames import sliced

from veilspark.functions.text import clean_lines, drop_blank_lines

_ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&")]


def native_text(html: Column, clean: bool = True, drop_blank: bool = True, links: bool = False) -> Column:
    """Text without scripts, styles, comments and tags; the frequent entities are decoded, & last. JVM-side.

    ``links`` writes a link with its address: text (url)."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", "")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    if links:
        t = F.regexp_replace(t, r'(?is)<a\s[^>]*?href="([^"]+)"[^>]*>([^<]+)</a\s*>', "$2 ($1)")
    t = F.regexp_replace(t, r"<[!/a-zA-Z][^>]*>", "")
    for a, b in _ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = clean_lines(t) if clean else t
    return drop_blank_lines(t) if drop_blank else t


class _Reader(HTMLParser):
    def __init__(self, links: bool):
        super().__init__(convert_charrefs=True)
        self.links, self.out, self.hidden, self.stack = links, [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "a" and self.links:
            self.stack.append((dict(attrs).get("href"), len(self.out)))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "a" and self.stack:
            url, at = self.stack.pop()
            if url and "".join(self.out[at:]):
                self.out.append(f" ({url})")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


_BARE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)")


def parse(html: str | None, clean: bool = True, drop_blank: bool = True, links: bool = False, bare: bool = True) -> str | None:
    """The text of a page. Without ``bare`` a reference counts only with its semicolon: a cut-off ``&amp`` stays as it is, where a browser reads ``&``."""
    if html is None:
        return None
    mark = "&" if bare else next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)  # a sign that the page doesn't have
    r = _Reader(links)
    r.feed(html if bare else _BARE.sub(mark, html))
    r.close()
    lines = "".join(r.out).replace(mark, "&").split("\n")
    if clean:
        lines = [" ".join(x.split()) for x in lines]
    if drop_blank:
        lines = [x for x in lines if x.strip()]
    return "\n".join(lines)


def parsed(df: DataFrame, column: str, out: str = "text", **options) -> DataFrame:
    """``df`` with the parsed text of ``column`` in ``out``."""
    source = df.drop(out) if out in df.columns and out != column else df
    names = [c for c in source.columns if c != out]
    at = source.columns.index(column)
    schema = source.select(*names, F.lit(None).cast("string").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            texts = pa.array([parse(t, **options) for t in b.column(b.schema.get_field_index(column)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [texts], names=[*names, out])

    return source.mapInArrow(run, schema)
