"""Which extractor and which writer a file gets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types and the kinds that they stand for.
MEDIA = {
    "text/plain": "txt",
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/html": "html",
    "image/png": "image",
    "image/jpeg": "image",
    "image/jpg": "image",
    "text/csv": "csv",
    "application/csv": "csv",
}
EXTENSIONS = {"txt": "txt", "pdf": "pdf", "docx": "docx", "html": "html", "htm": "html", "png": "image", "jpg": "image", "jpeg": "image", "csv": "csv"}
KINDS = ("txt", "pdf", "docx", "html", "image", "csv")


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; empty without one."""
    return F.when(F.contains(name, F.lit(".")), F.element_at(F.split(F.lower(name), r"\.", -1), -1)).otherwise("")


def kind(name: Column, media: Column) -> Column:
    """txt, pdf, docx, html, image or csv, by media type or extension, whichever comes first in this order; null if neither is known."""
    ext, m = extension(name), F.coalesce(media, F.lit(""))
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(m.isin(*[a for a, b in MEDIA.items() if b == k]) | ext.isin(*[a for a, b in EXTENSIONS.items() if b == k]), k).otherwise(out)
    return out


def download_media(name: Column) -> Column:
    """Media type of the scrubbed file: txt, docx, html and csv keep theirs, all else is plain text."""
    ext = extension(name)
    return F.when(ext == "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document").when(ext == "html", "text/html").when(ext == "csv", "text/csv").otherwise("text/plain")


def download_name(name: Column) -> Column:
    return F.concat(F.lit("scrubbed_"), name)


def ui_name(name: Column) -> Column:
    """<base>_scrubbed<ext> for the writable kinds, else <base>_scrubbed_ocr.txt."""
    ext = extension(name)
    base = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.when(ext.isin("txt", "docx", "html", "htm", "csv", "pdf"), F.concat(base, F.lit("_scrubbed."), ext)).otherwise(F.concat(base, F.lit("_scrubbed_ocr.txt")))
