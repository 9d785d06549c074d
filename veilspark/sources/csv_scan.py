"""CSV of any size, read in pieces: quoted cells may hold line ends, and still no file is one task's.

Whether a line begins inside a quoted cell depends on all lines before it, but each line does to that question one of four
things: it leaves it, turns it, or settles it either way. So every piece of a file sums up its own lines at once, a prefix
composition over the pieces (a row each) says in which state a piece begins, and each piece then cuts its records at true
line ends. What remains at a piece's ends is joined with its neighbours'. Cells are split by Spark.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilspark.functions.frames import sliced

def line_rule(sep: bytes = b",") -> re.Pattern:
    """Matches the cells of a line that begins outside of quotes, up to a quoted cell that the line doesn't end (group 1)."""
    s = re.escape(sep)
    cell = rb'(?:"[^"]*+(?:""[^"]*+)*+"[^%s]*+|(?!")[^%s]*+)' % (s, s)
    return re.compile(rb'%s(?:%s%s)*+(?:%s("))?' % (cell, s, cell, s) + rb'|(")')


HEADS = 1000  # ways to quote a header that are compared


class Lines:
    """What lines do to the state: False (outside) or True (inside a quoted cell)."""

    def __init__(self, sep: bytes):
        self.rule, self.sep = line_rule(sep), sep

    def outside(self, line: bytes) -> bool:
        """The state after a line that begins outside."""
        if line[:1] != b'"' and self.sep + b'"' not in line:
            return False
        m = self.rule.match(line)
        return bool(m and (m.group(1) or m.group(2)))

    def inside(self, line: bytes) -> bool:
        """The state after a line that begins inside."""
        at = 0
        while (at := line.find(b'"', at)) >= 0:
            if line[at + 1 : at + 2] != b'"':
                rest = line.find(self.sep, at)
                return rest >= 0 and self.outside(line[rest + len(self.sep) :])
            at += 2
        return True

    def after(self, line: bytes, state: bool) -> bool:
        return self.inside(line) if state else self.outside(line)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, bool]]:
    """path, begin, lines and the begin's state of stretches of one piece."""
    for b in sliced(batches, 2):
        path, begin = b.column(0), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(begin) != 0) | pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield path[lo].as_py(), int(begin[lo]), b.column(2).slice(lo, hi - lo), bool(b.column(3)[lo].as_py()) if b.num_columns > 3 else False


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, begin (of the piece) and line (bytes, without the line end) of text files, in the order of each piece."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("line"))


def piece_states(rows: DataFrame, sep: str = ",") -> DataFrame:
    """path, begin and inside of the pieces that begin inside a quoted cell. A row a piece: no more than Spark has tasks to plan."""
    known = Lines(sep.encode())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, [False, True]

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([states[0]]), pa.array([states[1]])], names=["path", "begin", "out_", "in_"])

        for path, begin, part, _ in _pieces(batches):
            if (path, begin) != key:
                if key:
                    yield done()
                key, states = (path, begin), [False, True]
            quoted = part.filter(pc.match_substring(part, '"'))  # others leave the state as it is
            for line in quoted.to_pylist():
                states = [known.after(line, s) for s in states] if states[0] != states[1] else [known.after(line, states[0])] * 2
        if key:
            yield done()

    done = rows.mapInArrow(sums, "path string, begin long, out_ boolean, in_ boolean")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col("out_") & ~F.col("in_"), 1).otherwise(0)).over(before), F.lit(0))
    turned = done.withColumn("turns", turns)
    settled = F.when(F.col("out_") == F.col("in_"), F.struct("out_", "turns"))
    last = F.last(settled, ignorenulls=True).over(before)
    state = turned.withColumn("last", last)
    inside = F.coalesce(F.col("last.out_"), F.lit(False)) != ((F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1)
    return state.select("path", "begin", inside.alias("inside")).where("inside")


def records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """path, begin, place and record (bytes) of all records of CSV files; (begin, place) is a file's order. Empty lines outside of quotes are none.

    Files are read twice, with their bytes dealt to tasks as Spark deals text; records that cross pieces are shuffled, no others."""
    rows, known = lines(spark, path), Lines(sep.encode())
    inside = F.broadcast(piece_states(rows, sep).select(F.col("path").alias("p_"), F.col("begin").alias("b_"), "inside"))
    told = rows.join(inside, (F.col("path") == F.col("p_")) & (F.col("begin") == F.col("b_")), "left").select("path", "begin", "line", F.coalesce("inside", F.lit(False)).alias("inside"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records; what is left at a piece's begin (kind 1: ended, 2: not ended in it) and end (kind 3)."""
        key, state, open_, first, place = None, False, [], False, 0

        blank = pa.array([b"", b"\r"])

        def batch(found: list[bytes] | pa.Array, kind: int, at: int) -> pa.RecordBatch:
            n = len(found)
            cols = [pa.repeat(pa.scalar(key[0]), n), pa.repeat(pa.scalar(key[1], pa.int64()), n), pa.array(np.arange(at, at + n)), pa.repeat(pa.scalar(kind, pa.int32()), n), found if isinstance(found, pa.Array) else pa.array(found, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["path", "begin", "place", "kind", "record"])

        def rest() -> Iterator[pa.RecordBatch]:
            if key and open_:
                yield batch([b"\n".join(open_)], 2 if first else 3, place)

        for path, begin, part, starts_inside in _pieces(batches):
            if (path, begin) != key:
                yield from rest()
                key, state, open_, first, place = (path, begin), starts_inside, [], starts_inside, 0
            if not state and not open_ and not pc.any(pc.match_substring(part, '"')).as_py():
                plain = part.filter(pc.invert(pc.is_in(part, blank)))
                if len(plain):
                    yield batch(plain, 0, place)
                    place += len(plain)
                continue
            found, at = [], place
            for line in part.to_pylist():
                was, state = state, known.after(line, state) if b'"' in line else state
                if state or was:
                    open_.append(line)
                    if not state:
                        whole, open_ = b"\n".join(open_), []
                        if first:
                            yield batch([whole], 1, place)
                            first, place = False, place + 1
                            at = place
                        else:
                            found.append(whole)
                            place += 1
                elif line not in (b"", b"\r"):
                    found.append(line)
                    place += 1
            if found:
                yield batch(found, 0, at)
        yield from rest()

    parts = told.mapInArrow(cut, "path string, begin long, place long, kind int, record binary")
    whole = parts.where("kind = 0")
    chain = F.sum(F.when(F.col("kind") == 3, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("begin", "place"))
    loose = parts.where("kind > 0").withColumn("chain", chain)  # two rows a piece at most
    joined = loose.groupBy("path", "chain").agg(F.sort_array(F.collect_list(F.struct("begin", "place", "record"))).alias("r"))
    text = F.concat_ws("\n", F.transform("r", lambda x: F.decode(x["record"], "ISO-8859-1")))  # a sign for each byte, so that bytes of any encoding come back as they were
    mended = joined.select("path", F.col("r")[0]["begin"].alias("begin"), F.col("r")[0]["place"].alias("place"), F.encode(text, "ISO-8859-1").alias("record"))
    return whole.select("path", "begin", "place", "record").unionByName(mended)


def _text(record: Column) -> Column:
    """A record that is UTF-8 as that, any other as Latin-1, which reads all bytes; without the line end's carriage return."""
    return F.regexp_replace(F.when(F.is_valid_utf8(record.cast("string")), F.decode(record, "UTF-8")).otherwise(F.decode(record, "ISO-8859-1")), "\r$", "")


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """CSV with a header, every column a string. Quotes are those of RFC 4180: doubled inside of a quoted cell, signs like others inside of an unquoted one.

    The header is a file's first record, which must begin in its first piece; files must have the same. Blank lines are no records. A record of
    too few cells has nulls, of too many loses them; empty unquoted cells are null, quoted ones are empty. Files without a record give no rows, and no columns if there is no other."""
    if len(sep.encode()) != 1:
        raise ValueError("a separator is one byte")
    rows = records(spark, path, sep)
    first = (F.col("begin") == 0) & (F.col("place") == 0)
    texts = [r.head.removeprefix("\ufeff") for r in rows.where(first).select(_text(F.col("record")).alias("head")).distinct().limit(HEADS).collect()]
    heads = {tuple(next(csv.reader(io.StringIO(t, newline=""), delimiter=sep))) for t in texts}
    if not heads:
        return spark.createDataFrame([], StructType([]))
    if len(heads) > 1:
        raise ValueError(f"files have different headers: {sorted(heads)[:2]}")
    (titles,) = heads
    cells = ", ".join(f"c{i} string" for i in range(len(titles)))
    none = uuid.uuid4().hex  # what Spark puts for an empty unquoted cell; with the default, an empty text, quoted cells would be null too
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": none, "emptyValue": "", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(titles))), "lineSep": "\x00"}
    split = rows.where(~first).select(F.from_csv(_text(F.col("record")), cells, options).alias("r"))
    return split.select(*[F.col(f"r.c{i}").alias(t or f"_c{i}") for i, t in enumerate(titles)])
