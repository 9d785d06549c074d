"""The audit log and keyed tables on disk, laid out so that a lookup opens few files and an update rewrites few.

A log is partitioned by batch, day and a hash bucket of the session; within a file rows are sorted by session and time, and
row groups carry Bloom filters of the ids. So a session's rows are one bucket's, found by its sorted row groups; a user's
rows skip the row groups whose filters lack the id; the newest rows are read from the newest days on. A keyed table is
partitioned by a bucket of its key: merging rows into it rewrites the buckets that they fall into, and no other file.
"""

from __future__ import annotations

import re
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.frames import delete, fresh

PAGE, MOST = 50, 100


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class AuditLog:
    """A log of interactions (session_id, user_id, action, timestamp and any other columns but batch, day and bucket).

    ``buckets`` is a property of the log: whoever opens it must name the number that it was written with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, row_group: int = 16 << 20, ids: int = 100_000):
        self.spark, self.path, self.buckets, self.row_group, self.ids = spark, path.rstrip("/"), buckets, row_group, ids

    def append(self, interactions: DataFrame, batch: str | None = None) -> str:
        """Write rows as a batch and return its name. A batch that is written again replaces itself: a replay adds nothing.

        Days and buckets that hold much are dealt to several tasks and files, so that a session of any share is no bottleneck."""
        batch = batch or uuid.uuid4().hex
        rows = interactions.withColumns({"day": F.to_date("timestamp"), "bucket": _bucket(F.col("session_id"), self.buckets)})
        rows = rows.hint("rebalance", F.col("day"), F.col("bucket")).sortWithinPartitions("day", "bucket", "session_id", "timestamp")
        out = rows.write.mode("overwrite").partitionBy("day", "bucket").option("parquet.block.size", self.row_group)
        for c in ("session_id", "user_id"):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", self.ids)
        out.parquet(f"{self.path}/batch=b-{batch}")
        return batch

    def read(self, *batches: str) -> DataFrame:
        """All rows, or those of the named batches."""
        places = [f"{self.path}/batch=b-{b}" for b in batches] or [self.path]
        return self.spark.read.option("basePath", self.path).parquet(*places)

    def truncate(self) -> None:
        """All batches go; the rows' columns are kept as an empty one."""
        empty = self.read().limit(0).drop("batch", "day", "bucket")
        delete(self.spark, self.path)
        empty.write.parquet(f"{self.path}/batch=b-{uuid.uuid4().hex}/day=1970-01-01/bucket=0")

    def session(self, session_id: str, action: str | None = None) -> DataFrame:
        """Rows of a session by time: one bucket is listed, its row groups are told by their least and largest session."""
        rows = self.read().where((F.col("bucket") == _bucket(F.lit(session_id), self.buckets)) & (F.col("session_id") == session_id))
        return (rows if action is None else rows.where(F.col("action") == action)).orderBy("timestamp")

    def record(self, session_id: str, action: str = "text_redacted") -> DataFrame:
        """The earliest record of a session."""
        return self.session(session_id, action).limit(1)

    def records(self, requests: DataFrame, action: str = "text_redacted") -> DataFrame:
        """``requests`` (session_id) with the earliest record of each as a struct ``record``, null if there is none.

        One join for any number of requests, on bucket and session, so that buckets that nobody asks for aren't read."""
        sid, record = fresh([c for c in requests.columns if c.lower() != "record"], "session", "record")
        requests = requests.drop("record")
        asked = requests.where("session_id IS NOT NULL").select("session_id").distinct().select(F.col("session_id").alias("sid"), _bucket(F.col("session_id"), self.buckets).alias("b"))
        rows = self.read().where(F.col("action") == action)
        mine = rows.join(asked, (F.col("bucket") == F.col("b")) & (F.col("session_id") == F.col("sid"))).drop("b", "sid")
        first = mine.groupBy(F.col("session_id").alias(sid)).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("batch", "day", "bucket")]), "timestamp").alias(record))
        return requests.join(first, F.col("session_id") == F.col(sid), "left").drop(sid)

    def days(self) -> list[date]:
        """Days of the log, newest first, from the names of its files."""
        found = {m.group(1) for f in self.read().inputFiles() if (m := re.search(r"/day=(\d{4}-\d\d-\d\d)/", f))}
        return sorted(map(date.fromisoformat, found), reverse=True)

    def newest(self, where: Column | None = None, limit: int = PAGE) -> DataFrame:
        """The newest rows (at most MOST), from the newest days: twice as many days are read until there are enough rows."""
        limit, days, n = min(limit, MOST), self.days(), 1
        while True:
            rows = self.read().where(F.col("day").isin(days[:n])) if n < len(days) else self.read()
            rows = rows if where is None else rows.where(where)
            if n >= len(days) or rows.limit(limit).count() >= limit:
                return rows.orderBy(F.desc("timestamp"), F.desc("session_id")).limit(limit)
            n *= 2

    def redactions(self, user_id: str | None = None, limit: int = PAGE) -> DataFrame:
        """Newest redactions, of a user or of all. A limit of 0 is none: then the user's row groups are told by their Bloom filters."""
        where = F.col("action") == "text_redacted"
        where = where if user_id is None else where & (F.col("user_id") == user_id)
        return self.newest(where, limit) if limit else self.read().where(where).orderBy(F.desc("timestamp"), F.desc("session_id"))


class KeyedTable:
    """A table with a row a key, in ``buckets`` partitions by the key's hash (column key_bucket)."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _write(self, rows: DataFrame) -> None:
        dealt = rows.hint("rebalance", F.col("key_bucket")).sortWithinPartitions("key_bucket", self.key)
        out = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_bucket")
        out.option(f"parquet.bloom.filter.enabled#{self.key}", "true").option(f"parquet.bloom.filter.expected.ndv#{self.key}", 100_000).parquet(self.path)

    def create(self, rows: DataFrame) -> KeyedTable:
        self._write(rows.withColumn("key_bucket", _bucket(F.col(self.key), self.buckets)))
        return self

    def stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self.stored().drop("key_bucket")

    def get(self, value: str | int) -> DataFrame:
        """The row of a key: one bucket is read."""
        return self.stored().where((F.col("key_bucket") == _bucket(F.lit(value), self.buckets)) & (F.col(self.key) == value)).drop("key_bucket")

    def merge(self, new: DataFrame, keep: tuple[str, ...] = ("created_at",), greatest: tuple[str, ...] = (), insert: bool = True) -> list[int]:
        """Set the rows of ``new`` over those of their keys, and return the buckets that were rewritten; others keep their files.

        Columns in ``keep`` are set on insert only, those in ``greatest`` never fall, columns that ``new`` lacks stay; without
        ``insert`` unknown keys are left out. ``new`` has a row a key and the key's type as stored; null keys are left out. Merging the same rows
        again changes nothing. Buckets are replaced once all of them are computed; a key is in one bucket, so that its reader sees either row."""
        names, key = self.read().columns, self.key
        new = new.where(F.col(key).isNotNull()).select(*[c for c in names if c in new.columns])
        new = new.withColumn("key_bucket", _bucket(F.col(key), self.buckets))
        old = self.stored()
        if not insert:
            new = new.join(old.select(key), key, "left_semi")
        touched = [r.key_bucket for r in new.select("key_bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return []
        old = old.where(F.col("key_bucket").isin(touched))
        both = old.alias("a").join(new.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.key_bucket") == F.col("b.key_bucket")), "full")

        def pick(c: str) -> Column:
            if c not in new.columns:
                return F.col(f"a.{c}")
            if c in greatest:
                return F.greatest(f"a.{c}", f"b.{c}").alias(c)
            first, second = ("a", "b") if c in keep else ("b", "a")
            return F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c)

        self._write(both.select(*[pick(c) for c in [*names, "key_bucket"]]))
        return sorted(touched)


def after(columns: list[tuple[str, bool]], last: list) -> Column:
    """Whether a row comes after ``last`` in the order of ``columns`` (name, descending): nulls come first in ascending and last in descending order."""
    out = F.lit(False)
    for (name, down), value in reversed(list(zip(columns, last, strict=True))):
        c = F.col(name)
        if value is None:
            beyond, same = (F.lit(False) if down else c.isNotNull()), c.isNull()
        else:
            beyond, same = ((c < F.lit(value)) | c.isNull() if down else c > F.lit(value)), c == F.lit(value)
        out = beyond | (same & out)
    return out


def seek_page(rows: DataFrame, columns: list[tuple[str, bool]], last: list | None = None, limit: int = PAGE) -> DataFrame:
    """The page behind the row ``last`` (values of ``columns``, which tell rows apart), or the first one: no row before it is sorted or skipped.

    Over a table that write_sorted() has laid out, row groups before the page aren't read."""
    rows = rows if last is None else rows.where(after(columns, last))
    return rows.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in columns]).limit(limit)


def seek_pages(rows: DataFrame, columns: list[tuple[str, bool]], limit: int = PAGE):
    """Pages one after the other, each as a list of rows."""
    last = None
    while page := seek_page(rows, columns, last, limit).collect():
        yield page
        last = [page[-1][c] for c, _ in columns]


def write_sorted(rows: DataFrame, path: str, columns: list[tuple[str, bool]], partitions: int | None = None, row_group: int = 16 << 20) -> None:
    """``rows`` in files that follow each other in the order of ``columns``."""
    order = [F.desc(c) if down else F.asc(c) for c, down in columns]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)

