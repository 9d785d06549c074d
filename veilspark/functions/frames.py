"""Helpers for frames of callers: names that don't clash, slices by bytes, the folder that a cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE = 4 << 20  # bytes of text that a pass in Python turns to objects at once


def fresh(names: list[str], *wanted: str) -> list[str]:
    """``wanted`` with underscores before them as long as they are among ``names``: columns of a caller may have ours' names."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in which a column of strings or bytes holds about ``most`` bytes; a longer value stands alone."""
    for b in batches:
        begin = held = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
            if i > begin and held + size > most:
                yield b.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if b.num_rows:
            yield b.slice(begin)


def given_back() -> None:
    """At the end of a task: memory that a worker has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir). Only a session of one process may go without."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/veilspark-{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def same_columns(df: DataFrame, *without: str) -> list[str]:
    """Names of ``df``'s columns but for ``without`` (in any case)."""
    gone = {w.lower() for w in without}
    return [c for c in df.columns if c.lower() not in gone]
