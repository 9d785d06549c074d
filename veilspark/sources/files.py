"""Files as tables: text, CSV and binary scans, and extraction of text from mixed files.

PDF and images need an extractor of the caller's: a function of bytes to text that is passed in (no such library is a
dependency). A file whose extractor fails gives an empty text, as an unreadable file does."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.frames import given_back, sliced
from veilspark.sources import docx, html
from veilspark.sources.csv_scan import read_csv
from veilspark.sources.router import kind


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text (strict UTF-8; a row a file)."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))


METRICS = "report string, confusion_matrix array<array<long>>"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A model's metrics file: report (text) and confusion_matrix."""
    return spark.read.schema(METRICS).json(path, multiLine=True)


def metrics_of(text: Column) -> Column:
    """The same of a column that holds such a file's text."""
    return F.from_json(text, METRICS)


def csv_text(content: bytes) -> str:
    """CSV as text: UTF-8, else the first of the single-byte encodings that reads it; typed columns, printed as a table without an index."""
    import io

    import pandas as pd

    for name in ("utf-8", "latin-1", "iso-8859-1", "cp1252"):
        try:
            return pd.read_csv(io.BytesIO(content), encoding=name).to_string(index=False)
        except UnicodeDecodeError:
            continue
    return ""


__all__ = ["EXTRACTORS", "batch_report", "csv_text", "extract", "metrics_of", "read_csv", "read_metrics", "read_text"]

EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "txt": lambda b: b.decode("utf-8"),
    "html": lambda b: html.parse(b.decode("utf-8")),
    "docx": docx.read,
    "csv": csv_text,
}


def extract(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, kind, text, ok and reason of binary files (path, content; from ``spark.read.format("binaryFile")`` with any glob).

    ``reason`` says why there is no text: no kind, no extractor for it, no content, what its reader said, or that it found nothing.
    Spark packs small files into a task by their sizes; a large one has a task, and its content is one value."""
    known = EXTRACTORS | (extractors or {})
    source = files.select("path", kind(F.col("path"), F.lit(None).cast("string")).alias("kind"), "content")

    def one(k: str | None, content: bytes | None) -> tuple[str, str | None]:
        if k is None or k not in known:
            return "", "unknown kind" if k is None else f"no extractor for {k}"
        if content is None:
            return "", "no content"
        try:
            text = known[k](content).strip()
        except Exception as e:  # an unreadable file is an empty one, whatever its reader says
            return "", type(e).__name__
        return text, None if text else "no text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):  # a large file is a slice of its own
            found = [one(k, content.as_py()) for k, content in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
            texts, reasons = ([x[i] for x in found] for i in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([t != "" for t in texts]), pa.array(reasons, pa.string())], names=["path", "kind", "text", "ok", "reason"])
        given_back()

    return source.mapInArrow(run, "path string, kind string, text string, ok boolean, reason string")


def batch_report(extracted: DataFrame) -> DataFrame:
    return extracted.agg(F.count("*").alias("files"), F.count_if("ok").alias("converted"))


def failures(extracted: DataFrame) -> DataFrame:
    """kind, reason and files of what wasn't converted."""
    return extracted.where("NOT ok").groupBy("kind", "reason").agg(F.count("*").alias("files"))
