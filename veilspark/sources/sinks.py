"""Texts as files: bytes for TXT, HTML, DOCX and CSV, and appends to tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.frames import fresh, given_back, same_columns, sliced
from veilspark.sources import docx
from veilspark.sources.router import extension

# Fixed value: a page up to its first paragraph; a sign a level of indentation, a line for each tag and text.
_HEAD = """<html>
 <head>
  <meta charset="utf-8"/>
  <meta content="width=device-width, initial-scale=1.0" name="viewport"/>
  <title>
   Scrubbed Document
  </title>
  <style>
   body { font-family: sans-serif; line-height: 1.6; max-width: 800px; margin: 0 auto; }
  </style>
 </head>
 <body>
  <div class="container">
   <h1>
    Scrubbed Document
   </h1>
"""
_FOOT = "  </div>\n </body>\n</html>\n"
_BLANK = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html(text: Column) -> Column:
    """An indented page: a heading, blocks between empty lines as paragraphs, line ends within them as breaks; text is escaped.

    Texts lose the white space around their lines, and a line without anything else has no line of its own."""
    bare = lambda x: F.regexp_replace(x, f"^{_BLANK}|{_BLANK}$", "")
    line = lambda x: F.when(x != "", F.concat(F.lit("    "), x, F.lit("\n"))).otherwise("")
    blocks = F.filter(F.transform(F.split(escaped(text), "\n\n", -1), bare), lambda x: x != "")
    lines = lambda x: F.array_join(F.transform(F.split(x, "\n", -1), lambda y: line(bare(y))), "    <br/>\n")
    body = F.array_join(F.transform(blocks, lambda x: F.concat(F.lit("   <p>\n"), lines(x), F.lit("   </p>\n"))), "")
    return F.concat(F.lit(_HEAD), body, F.lit(_FOOT))


def rendered(df: DataFrame, name: str = "filename", text: str = "text", pdf: Callable[[str], bytes] | None = None) -> DataFrame:
    """``df`` with column content: the bytes of the scrubbed file, by the name's extension. PDF needs a writer of the caller's; else it is plain text."""
    keep = same_columns(df, "content")
    ext, body, page = fresh([*df.columns, "content"], "ext", "body", "page")
    made = df.select(*keep, F.col(text).alias(body), extension(F.col(name)).alias(ext)).withColumn(page, F.when(F.col(ext) == "html", html(F.col(body))))
    schema = df.select(*keep, F.lit(None).cast("binary").alias("content")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, len(keep)):
            out = []
            for t, ext, page in zip(*(b.column(len(keep) + k).to_pylist() for k in range(3)), strict=True):
                out.append(None if t is None else docx.write(t) if ext == "docx" else page.encode() if ext == "html" else pdf(t) if ext == "pdf" and pdf else t.encode())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.binary())], names=[*keep, "content"])
        given_back()

    return made.mapInArrow(run, schema)


def append(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def width_of(df: DataFrame, mappings: str) -> int:
    """The most structs that an array column holds: one aggregate over the table."""
    return df.agg(F.max(F.size(mappings)).alias("n")).first().n or 0


def wide(df: DataFrame, mappings: str, width: int | None = None) -> DataFrame:
    """``df`` with the structs of an array column as columns num_entities and entity_{i}_type, _original, _placeholder and _confidence.

    Without ``width`` there are as many as the longest array needs, so that none is lost; that costs a pass."""
    width = width_of(df, mappings) if width is None else width
    fields = {f: f.removeprefix("entity_") for f in df.schema[mappings].dataType.elementType.names}
    columns = {f"entity_{i}_{n}": F.get(F.col(mappings), F.lit(i))[f] for i in range(width) for f, n in fields.items()}
    return df.withColumns({"num_entities": F.coalesce(F.size(mappings), F.lit(0)), **columns}).drop(mappings)


def write_dataset(df: DataFrame, path: str, mappings: str = "entity_mappings", width: int | None = None) -> None:
    """A generated data set as CSV (wide, all entities) and as JSON lines (nested), below ``path``."""
    wide(df, mappings, width).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def generated(df: DataFrame, prompt: str, answer: Callable[[list[str]], list[str]], out: str = "response") -> DataFrame:
    """``df`` with the answers of the caller's text generator (batches of prompts to batches of texts). None is built in."""
    source = df.drop(out) if out in df.columns else df
    names = source.columns
    schema = source.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, names.index(prompt)):
            texts = [t.strip() for t in answer(b.column(names.index(prompt)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, out])

    return source.mapInArrow(run, schema)
