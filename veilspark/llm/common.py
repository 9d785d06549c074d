"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS = 1 << 29  # of a KeyFilter, at most: 64 MB
_MAP_BITS = 1 << 15  # of one bitmap that Spark builds


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A folder of our own is set only where the session names none and runs in one process; a cluster must name one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


_written: list[str] = []  # folders of stage() that are still there
_run: contextvars.ContextVar[Folders | None] = contextvars.ContextVar("run", default=None)


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark-{what}-{uuid.uuid4().hex}"
    _written.append(path)
    if run := _run.get():
        run.paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete the folders of frames from stage() whose readers are all written."""
    for df in frames:
        _delete(df.sparkSession, df.staged_at)


class Folders:
    """The folders that stage() writes inside ``with Folders() as mine``, in this thread: those of one run, and of no other."""

    def __enter__(self) -> Folders:
        self.paths: list[str] = []
        self._outer = _run.set(self)
        return self

    def __exit__(self, *_) -> None:
        _run.reset(self._outer)

    def delete(self, spark: SparkSession, keep: DataFrame | None = None) -> None:
        """Delete them, but for that of ``keep``."""
        kept = keep.staged_at if keep is not None else None
        for path in self.paths:
            if path != kept:
                _delete(spark, path)
        self.paths = [p for p in self.paths if p == kept]


def staged() -> int:
    """How many folders of stage() are there."""
    return len(_written)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _written:
        _written.remove(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class KeyFilter:
    """Tells rows whose key may be among those of a table from rows whose key is not, without a shuffle of the rows.

    A Bloom filter of one hash function, sixteen bits a key and FILTER_BITS at most, made of Spark's bitmaps: a table
    of 4 kB rows, which is broadcast. Beyond FILTER_BITS / 16 keys more rows are let through in vain; none is missed at any
    size, and a join with the keys decides. Nulls in a key are values like others."""

    def __init__(self, keys: DataFrame, *columns: str):
        maps = min(1 << max(0, (16 * keys.count() - 1).bit_length() - 15), FILTER_BITS // _MAP_BITS)
        self.bits = maps * _MAP_BITS
        at = keys.select(self._place([F.col(c) for c in columns]).alias("at"))
        bitmap = F.bitmap_construct_agg(F.col("at") % _MAP_BITS)
        self.maps = at.groupBy(F.floor(F.col("at") / _MAP_BITS).alias("map_no")).agg(bitmap.alias("bitmap"))

    def _place(self, key: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*[c for k in key for c in (k, k.isNull())]), F.lit(self.bits))

    def flagged(self, df: DataFrame, flag: str, *columns: str) -> DataFrame:
        """``df`` with a column ``flag``: false where the key isn't in the table, true where it may be."""
        at, number, bitmap = fresh(df.withColumn(flag, F.lit(True)), "at", "map_no", "bitmap")
        rows = df.withColumn(at, self._place([F.col(c) for c in columns]))
        maps = F.broadcast(self.maps.select(F.col("map_no").alias(number), F.col("bitmap").alias(bitmap)))
        rows = rows.join(maps, F.floor(F.col(at) / _MAP_BITS) == F.col(number), "left")
        byte = F.conv(F.hex(F.substring(F.col(bitmap), ((F.col(at) % _MAP_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = byte.bitwiseAND(F.pow(F.lit(2.0), F.col(at) % 8).cast("int"))
        return rows.withColumn(flag, F.coalesce(bit > 0, F.lit(False))).drop(at, number, bitmap)

    def hits(self, df: DataFrame, *columns: str) -> DataFrame:
        """The rows of ``df`` whose key may be in the table."""
        (flag,) = fresh(df, "may_be")
        return self.flagged(df, flag, *columns).where(F.col(flag)).drop(flag)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made from ``names``: columns of a caller may clash with ours."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


_held: dict[str, Callable[[], None]] = {}  # by module: what empties its caches
_owner: list[str] = []


def holds(module: str, empty: Callable[[], None]) -> None:
    """Says how the caches are emptied that a module keeps in a Python worker between its tasks."""
    _held[module] = empty


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow in a worker that serves many operators: caches of the operator before go, and freed memory goes back to the system."""
    module = run.__module__

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _claim(module)
        yield from run(batches)
        _give_back()

    return inner


def _claim(module: str) -> None:
    if _owner != [module]:
        for other, empty in _held.items():
            if other != module:
                empty()
        _owner[:] = [module]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    _trim()(0)


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def rows_by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` (string or binary) holds about ``most`` bytes; a longer value stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(at)).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            size = size or 0
            if i > begin and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096, most: int = 1 << 40, free: str | None = None) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, or ``most`` bytes, or more in which no group is cut, from batches that are sorted by ``keys``.

    ``free``: a column that is true for rows, a group's last ones, between which it may be cut."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        size += b.nbytes
        if n < rows and size < most:
            continue
        t = pa.Table.from_batches(held)
        if free and t.column(free)[n - 1].as_py():
            yield t
            held, n, size = [], 0, 0
            continue
        last = [t.column(k)[n - 1].as_py() for k in keys]
        lo, hi = 0, n - 1  # the last group's first row
        while lo < hi:
            mid = (lo + hi) // 2
            if [t.column(k)[mid].as_py() for k in keys] == last:
                hi = mid
            else:
                lo = mid + 1
            # rows are sorted, but a group's rows stand together at the end: bisection finds where they begin
        if lo:
            yield t.slice(0, lo)
            held, n = t.slice(lo).to_batches(), n - lo
            size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)


def group_starts(t: pa.Table, keys: list[str]) -> list[int]:
    """First rows of the groups of a sorted table, and the number of rows."""
    if not t.num_rows:
        return [0]
    new = None
    for k in keys:
        c = t.column(k).combine_chunks()
        x = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)), False).to_numpy(zero_copy_only=False)
        new = x if new is None else new | x
    return [0, *(new.nonzero()[0] + 1).tolist(), t.num_rows]
